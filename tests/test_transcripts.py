"""Transcript metrics on events written out here, with the values counted by hand."""

import json

from depscape.operators.transcripts import json_paths, shell_reads, transcript_metrics
from pyspark.sql import functions as F


def use(i, name, nested=None, message="m1", **given):
    return {"type": "assistant", "parent_tool_use_id": nested, "message": {"id": message, "content": [{"type": "tool_use", "id": i, "name": name, "input": given}]}}


def got(i, content, is_error=False):
    return {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": content, "is_error": is_error}]}}


RUN = [
    {"type": "system", "subtype": "init", "cwd": "/w/tree/"},
    use("1", "Bash", command="cd lib && cat a.py ../b.py; grep -n x 'no such.py'"),
    got("1", "text"),
    use("2", "Bash", command="depscape refs a.f", message="m2"),
    got("2", [{"type": "text", "text": "f: COMPLETE"}, {"type": "text", "text": ' {"stale": true}'}]),
    use("3", "Grep", pattern="f", message="m3"),
    use("4", "Bash", nested="3", command="find .", message="m4"),
    use("5", "Read", file_path="/w/tree/lib/a.py", message="m3"),
    use("6", "Bash", command="sed -n 1,5p c.py | head -2; cd /w/tree; cat lib/c.py", message="m5"),
    use("7", "Edit", file_path="/w/tree/lib/a.py", message="m6"),
    got("8", "COMPLETE", True),
    {"type": "result", "subtype": "success", "num_turns": 4, "duration_ms": 10, "result": "done", "usage": {"input_tokens": 5}},
    {"type": "result", "subtype": "late", "num_turns": 1, "duration_ms": 3, "is_error": True},
]


def table(spark, runs):
    rows = [(run, i, x if isinstance(x, str) else json.dumps(x)) for run, events in runs.items() for i, x in enumerate(events)]
    return spark.createDataFrame(rows, "run string, seq long, line string")


def test_metrics(spark):
    lines = table(spark, {"r": [*RUN, "no json", "[1]"], "bare": [{"type": "user", "message": {"content": "hello"}}]})
    rows = {r["run"]: r.asDict() for r in transcript_metrics(lines).collect()}
    r = rows["r"]
    assert (r["round_trips"], r["tool_calls"], r["subagent_calls"], r["calls_before_first_edit"]) == (5, 7, 1, 6)
    assert r["tools"] == {"Bash": 4, "Edit": 1, "Grep": 1, "Read": 1} and r["files_read"] == ["lib/a.py"]
    assert r["shell"]["list"] == 1 and sum(r["shell"].values()) == 4
    assert r["complete"] and (r["searches_after_complete"], r["hook_answers"], r["stale_results"]) == (1, 1, 1)
    assert (r["result_events"], r["num_turns"], r["duration_ms"], r["stop_reason"], r["is_error"], r["final_text"], r["input_tokens"]) == (2, 5, 13, "late", True, "", None)
    b = rows["bare"]
    assert (b["round_trips"], b["tool_calls"], b["num_turns"], b["complete"], b["searches_after_complete"], b["tools"]) == (0, 0, None, False, None, {})
    assert not transcript_metrics(lines.limit(0)).collect()


def test_reads_and_folders_of_commands(spark):
    known = spark.createDataFrame([("r", p) for p in ("lib/a.py", "b.py", "lib/c.py", "c.py")], "run string, path string")
    rows = [(r["cwd"], r["reads"]) for r in shell_reads(table(spark, {"r": RUN}), known).orderBy("seq").collect()]
    assert rows == [(".", ["b.py", "lib/a.py"]), ("lib", []), ("lib", ["lib/c.py"])]


def test_paths_of_nested_json(spark):
    value = {"path": "a.py", "x": [{"file": 'b "q".py', "note": '"path": "no.py"'}, {"path": {"file": "c.py"}}], "file": 3}
    df = spark.createDataFrame([(json.dumps(value),), ("{}",), (None,)], "t string").select(json_paths(F.col("t")).alias("p"))
    assert [r["p"] for r in df.collect()] == [["a.py", 'b "q".py', "c.py"], [], None]
