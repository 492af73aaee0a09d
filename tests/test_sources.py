"""Source trees read from disk, and the scalars of logs and transcripts."""

from pyspark.sql import functions as F

from depscape.engine import Repository
from depscape.operators import analytics, search
from depscape.sources import tree

FILES = {
    "pkg/__init__.py": "from pkg._core import start\n",
    "pkg/_core.py": "def start():\n    return stop()\n\n\ndef stop():\n    return 0\n",
    "pkg/main.py": "import pkg\n\n\ndef main():\n    return pkg.start()\n",
    "pkg/made/out.py": "x = 1\n",
    "pkg/made/kept.py": "y = 1\n",
    "pkg/.gitignore": "/made/*\n!kept.py\n# comment\n",
    "_tools/run.py": "def run():\n    return 1\n",
    ".hidden/h.py": "h = 1\n",
    "venv/lib/v.py": "v = 1\n",
    "node_modules/n.py": "start = 1\n",
    "scratch.py": "s = 1\n",
    ".gitignore": "scratch.py\n",
    "server.pem": "start " * 1000,
    ".env": "start=1\n",
    "README.md": "call start\n",
}


def lay_out(root):
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    return f"file://{root}"


def test_python_files_of_a_tree(spark, tmp_path):
    root = lay_out(tmp_path)
    got = {r.path: bytes(r.content).decode() for r in tree.python_files(spark, root).collect()}
    names = ["pkg/__init__.py", "pkg/_core.py", "pkg/main.py", "pkg/made/kept.py", "_tools/run.py"]
    assert got == {p: FILES[p] for p in names}
    assert {r.path for r in tree.python_files(spark, root, ["main.py"]).collect()} == set(names) - {"pkg/main.py"}
    assert {r.path for r in tree.python_files(spark, root, folder="_tools").collect()} == {"_tools/run.py"}
    assert {r.path for r in tree.listing(spark, root).collect()} == set(FILES)


def test_rejected_files_are_not_opened(spark, tmp_path):
    root = lay_out(tmp_path)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # opening server.pem would fail
    try:
        files = tree.contents(spark, root, search.accepted(search.SearchSpec(["start"]), F.col("path")))
        assert {r.path for r in files.collect()} == {"pkg/__init__.py", "pkg/_core.py", "pkg/main.py", "pkg/made/out.py", "pkg/made/kept.py", "_tools/run.py", "scratch.py", "README.md"}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert search.secrets_skipped(search.SearchSpec(["start"]), tree.listing(spark, root)).first().n == 2


def test_repository_resolves_through_packages(spark, tmp_path):
    root = lay_out(tmp_path / "tree")
    repo = Repository(spark, root, f"file://{tmp_path}/store")
    repo.index()
    blast = repo.blast("pkg._core.stop")
    assert blast["result"]["direct"]["callers"] == 1
    assert {r.path for r in repo.store.read("file").collect()} >= {"pkg/__init__.py", "pkg/_core.py"}


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").withColumn("y", f(F.col("x")))
    return [r.y for r in df.orderBy("i").collect()]


def test_command_categories(spark):
    want = {
        "cd /a && (grep -n x y": "search", "git grep z": "search", "git log": "git", "/usr/bin/find . -name x": "list", "wc -l a": "read",
        "sed -n 1,3p a.py": "read", "sed -n -i s/a/b/ f": "edit", "sed -ni p f": "read", "perl -pi -e 1 f": "other", "echo hi > out.md": "edit",
        "python3 -c \"open('a', 'w')\"": "edit", "uv run x": "run", "node a.js": "other", "": "other", "( cd x; cd y; ls": "list", "lens show": "graph",
    }
    assert dict(zip(want, column(spark, want, lambda c: analytics.bash_category(c, "lens")))) == want
    assert column(spark, [None], analytics.bash_category) == ["other"]
    tools = {"Grep": "localize", "Agent": "localize", "Read": "read", "Write": "edit", "WebFetch": "other"}
    assert column(spark, tools, lambda c: analytics.call_phase(c, F.lit(None).cast("string"))) == list(tools.values())
    assert column(spark, ["git show", "make"], lambda c: analytics.call_phase(F.lit("Bash"), c)) == ["read", "test"]


def test_answer_keys(spark):
    text = "# lib/a.py:9\nlib/a.py:3,1,2: def f\nlib/b.py:7: x\nlib/b.py:7: again\nno key here\nlib/c.py:12    a:1\nlib/d.py:x,4\n"
    assert column(spark, [text], analytics.answer_keys) == [["lib/a.py:1", "lib/a.py:2", "lib/a.py:3", "lib/b.py:7", "lib/c.py:12", "lib/d.py:4"]]
    assert column(spark, ["4,5: x\n6: y\n# 7: z"], lambda c: analytics.answer_keys(c, F.lit("m.py"))) == [["m.py:4", "m.py:5", "m.py:6"]]


def test_export_is_numbered_by_file(spark, tmp_path):
    import json

    symbols = [{"i": i, "file": f"f{i % 3}.py", "name": f"s{i}"} for i in range(20)]
    edges = [{"src": i, "dst": (i * 7) % 20, "kind": "calls", "prov": "inferred"} for i in range(20)] * 2
    for name, rows in (("symbols", symbols), ("edges", edges)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    s, e = tree.edge_files(spark, f"file://{tmp_path}")
    want = {r["name"]: n for n, r in enumerate(sorted(symbols, key=lambda r: (r["file"], r["i"])))}
    assert {r.name: r.i for r in s.collect()} == want
    assert sorted((r.src, r.dst) for r in e.collect()) == sorted((want[f"s{i}"], want[f"s{i * 7 % 20}"]) for i in range(20))


def test_overlaps_by_command(spark):
    rows = [
        ("a1", "x", "s", 0, 1, "k", 5),
        ("a2", "x", "s", 10, 2, "k", 5),  # same command before
        ("a3", "y", "s", 20, 3, "k", 5),  # another command before
        ("a4", "z", "s", 20_000, 4, "k", 5),  # too late
        ("a5", "y", "t", 25, 5, "k", 5),  # another session
        ("a6", None, "s", 20_001, 6, "k", 5),  # of no command
        ("a7", "w", "s", 20_002, 7, "k", 5),
    ]
    keys = spark.createDataFrame(rows, "answer string, command string, session string, ts long, seq long, key string, bytes long")
    got = {r.answer: (r.intra, r.cross) for r in analytics.overlaps(keys).collect()}
    assert got == {"a1": (False, False), "a2": (True, False), "a3": (False, True), "a4": (False, False), "a5": (False, False), "a6": (False, False), "a7": (False, True)}
