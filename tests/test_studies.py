"""Replay reports, mined commits, leaks, truth of questions, log records and benchmark reports on small inputs."""

import pytest
from pyspark.sql import functions as F

from depscape.operators import studies as st

DIFF = """diff --git a/lib/core.py b/lib/core.py
--- a/lib/core.py
+++ b/lib/core.py
@@ -3,1 +3,1 @@ class Store:
-    def load_all(self, a):
+    def load_all(self, a, b):
-def __hidden(x):
+def __hidden(x, y):
+def fresh(z):
diff --git a/app/one.py b/app/one.py
--- a/app/one.py
+++ b/app/one.py
@@ -9,1 +9,1 @@ def use(s):
-    s.load_all(1)
+    s.load_all(1, 2)
diff --git a/tests/test_two.py b/tests/test_two.py
--- a/tests/test_two.py
+++ b/tests/test_two.py
@@ -1,1 +1,1 @@ def test_it():
+    assert load_all(3, 4)
diff --git a/notes.md b/notes.md
--- a/notes.md
+++ b/notes.md
+load_all(5)"""


@pytest.fixture(scope="module")
def diffs(spark):
    same = "+++ b/a.py\n-def f(x):\n+def f(x):\n+++ b/b.py\n+f(1)"
    return spark.createDataFrame([("c1", DIFF), ("c2", same), ("c3", "+++ b/a.py\n-def f(x):\n+def f(y):\n+f(1)"), ("c4", ""), ("c5", None)], "sha string, diff string")


def test_mining(diffs):
    rows = st.diff_rows(diffs)
    assert {tuple(r) for r in st.changed_definitions(rows).collect()} == {("c1", "load_all"), ("c3", "f")}
    assert [tuple(r) for r in st.mined_commits(diffs).collect()] == [("c1", ["load_all"], 3, 3)]
    assert not st.mined_commits(diffs, most_files=2).collect()
    got = {(r["kind"], r["name"]) for r in st.touched(rows).filter("sha = 'c1'").collect()}
    assert got == {("path", p) for p in ("lib/core.py", "app/one.py", "tests/test_two.py", "notes.md")} | {("symbol", s) for s in ("Store", "load_all", "fresh", "use")}


@pytest.mark.parametrize(
    ("statement", "want"),
    [
        ("Fix load_all in lib/core.py", {("path", "lib/core.py"), ("symbol", "load_all")}),
        ("See core.py; use a fresh store", {("file", "core.py")}),
        ("Call `fresh`, then use(1) of the Store", {("symbol", "fresh"), ("symbol", "use"), ("symbol", "Store")}),
        ("my-core.py and reload_all and load_all-x", set()),
        ("", set()),
    ],
)
def test_leaks(spark, diffs, statement, want):
    parts = st.touched(st.diff_rows(diffs.filter("sha = 'c1'")))
    got = st.leaks(spark.createDataFrame([("c1", statement)], "sha string, statement string"), parts)
    assert {(r["kind"], r["name"]) for r in got.collect()} == want


def test_truth_of_questions(spark):
    files = [
        ("lib/a.py", "def go(x):\n    return x\n"),
        ("lib/b.py", "import a\n\ndef run():\n    return a.go (1) + a.go(2)\n"),
        ("lib/c.py", '"""Calls go(1)."""\n# go(2)\nx = "go(3)"\n'),
        ("tests/test_a.py", "assert go(1)\n"),
        ("lib/d.py", "async def go(y):\n    go(y)\n"),
        ("lib/e.py", "ergo(1)\n"),
        ("lib/f.py", None),
    ]
    got = st.question_truth(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame([("go",)], "symbol string"))
    assert {(r["path"], r["role"]) for r in got.collect()} == {
        ("lib/a.py", "defined_in"), ("lib/b.py", "callers"), ("lib/c.py", "mentioned_only"), ("tests/test_a.py", "test_callers"), ("lib/d.py", "defined_in"), ("lib/d.py", "callers"),
    }


def test_replays(spark):
    schema = "build string, rewrite boolean, reason string, hook_bytes long, plain_bytes long, hook_code int, plain_code int, searches array<struct<sites:int,lost:int,header_ok:boolean>>"
    rows = [
        ("new", True, None, 10, 40, 0, 0, [(5, 1, True), (2, 0, False)]), ("new", True, None, 20, 20, 1, 0, None), ("new", False, "pipe", 99, 99, 0, 1, None),
        ("old", False, "pipe", None, None, None, None, None), ("old", False, "write", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["build"]: tuple(r)[1:] for r in st.replay_report(df).collect()}
    assert got == {"new": (2, 1, 30, 60, 1, 2, 7, 1, 1, 0.5), "old": (0, 2, 0, 0, 0, 0, 0, 0, 0, 0.0)}
    assert {tuple(r) for r in st.passed_reasons(df).collect()} == {("new", "pipe", 1), ("old", "pipe", 1), ("old", "write", 1)}
    same = spark.createDataFrame([("./a/b.py", "b.py", True), ("/x/b.py", "w/x/b.py", True), ("a.py", "b.py", False)], "a string, b string, w boolean")
    assert all(r["s"] == r["w"] for r in same.select(st.same_file(F.col("a"), F.col("b")).alias("s"), "w").collect())


def test_log_records(spark, tmp_path):
    texts = ["a" * 5, "aaaaé", "aaaé", "aaa€", "aa€", "aaa😀", "aa😀b", "a😀b", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", st.cut_bytes(F.col("t"), 5).alias("c")).collect()
    for r in got:
        assert r["c"] == (None if r["t"] is None else r["t"].encode()[:5].decode(errors="ignore"))
    events = spark.createDataFrame([("pre", "é" * 20_000, "x"), ("post", None, "x" * 200_001)], "event string, answer string, record string")
    st.append_log(events, f"file://{tmp_path}/log")
    st.append_log(events.limit(0), f"file://{tmp_path}/log")
    rows = {r["event"]: r for r in spark.read.json(f"file://{tmp_path}/log").collect()}
    assert rows["pre"]["answer"] == "é" * 10_000 and rows["pre"]["record"] == "x" and rows["pre"]["record_omitted"] is None
    assert rows["post"]["record"] is None and rows["post"]["record_omitted"]


def test_reports(spark):
    m = [("a", "s", v, k, x) for v, k, x in [("x", "correct", 0.0), ("x", "t", 1.0), ("y", "correct", 1.0), ("y", "t", 5.0), ("z", "correct", 1.0), ("z", "t", 4.0)]]
    m += [("b", "s", "x", "t", 2.0), ("b", "s", "y", "t", None)]
    got = st.best_variants(spark.createDataFrame(m, "engine string, size string, variant string, metric string, value double"), "t")
    assert {tuple(r) for r in got.collect()} == {("a", "s", "z", 4.0), ("b", "s", "x", 2.0)}
    shown = spark.createDataFrame([(None,), (1500.0,), (12.4,), (3.21,)], "us double").select(st.shown_time(F.col("us")).alias("s"))
    assert [r["s"] for r in shown.collect()] == ["—", "1.5 ms", "12 µs", "3.2 µs"]
    runs = spark.createDataFrame([("r1", 3), ("r2", 5)], "run_id string, num_turns int")
    again = st.recounted(runs, spark.createDataFrame([("r1", 4)], "run_id string, num_turns int"))
    assert {tuple(r) for r in again.select("run_id", "num_turns", "turns_recounted_from").collect()} == {("r1", 4, 3), ("r2", 5, None)}
    used = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "used string, answers double")
    assert {tuple(r) for r in st.attribution_counts(used, ("answers",)).collect()} == {("a", 2, 2.0), ("b", 1, None)}
