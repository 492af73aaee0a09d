"""Agent transcripts, one JSON event a line: what a run called, read and edited, and what it cost.

Events are (run, seq, line).  Lines that aren't JSON objects are skipped.  Everything is expressions and
windows within a run, except the reads of shell commands, which need a shell's word splitting and the working
directory so far: those take one run's commands at a time.
"""

from __future__ import annotations

import posixpath
import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import READ, SEARCH, answer_is_complete, bash_category

# Tools that edit; first words of commands that read files, beside those of the categories read and search.
EDIT_TOOLS = ("Edit", "Write", "NotebookEdit", "MultiEdit")
READERS = (*READ, *SEARCH, "rg", "less", "more", "bat", "diff", "file", "stat")
_EVENT = """type string, subtype string, cwd string, parent_tool_use_id string, message struct<id: string, content: string>, num_turns long, duration_ms long,
total_cost_usd double, is_error boolean, result string, usage struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>"""
_BLOCKS = "array<struct<type: string, id: string, name: string, input: string, tool_use_id: string, is_error: boolean, content: string>>"


def json_paths(text: Column) -> Column:
    """Sorted distinct strings under the keys ``path`` and ``file`` anywhere in a JSON text.

    A quoted key is followed by a colon, and a quote within a string by a backslash, so a pattern finds just the keys."""
    raw = F.regexp_extract_all(text, F.lit(r'(?<!\\)"(?:path|file)"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1))
    return F.array_sort(F.array_distinct(F.from_json(F.concat(F.lit("["), F.array_join(raw, ","), F.lit("]")), "array<string>")))


def events_of(lines: DataFrame) -> DataFrame:
    """run, seq and the event's fields; null where a line isn't an object."""
    e = F.from_json("line", _EVENT)
    return lines.select("run", "seq", e.alias("e"), "line").filter("e.type is not null").select("run", "seq", "e.*", "line")


def blocks_of(events: DataFrame) -> DataFrame:
    """One row a content block of assistant and user events: run, seq, pos, event, message_id, nested, and the block's fields."""
    kept = events.filter(F.col("type").isin("assistant", "user"))
    kept = kept.withColumn("blocks", F.from_json("message.content", _BLOCKS)).filter("blocks is not null")
    out = kept.select(
        "run", "seq", F.col("type").alias("event"), F.col("message.id").alias("message_id"), F.col("parent_tool_use_id").isNotNull().alias("nested"), F.posexplode("blocks").alias("pos", "b")
    )
    return out.select("run", "seq", "pos", "event", "message_id", "nested", "b.*")


def block_text(content: Column) -> Column:
    """Text of a tool result: a plain string, or its parts' texts joined."""
    parts = F.from_json(content, "array<struct<text: string>>")
    return F.when(F.startswith(content, F.lit("[")) & parts.isNotNull(), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(content)


def transcript_calls(lines: DataFrame, graph_tool: str = "depscape") -> DataFrame:
    """run, seq, pos, call (1, 2, ... in a run), nested, name, command, category, is_edit, asks_graph, id of every tool call."""
    b = blocks_of(events_of(lines)).filter("event = 'assistant' and type = 'tool_use'")
    command = F.get_json_object("input", "$.command")
    category = F.when(F.col("name") == "Bash", bash_category(command))
    c = b.select("run", "seq", "pos", "nested", "id", F.coalesce("name", F.lit("?")).alias("name"), command.alias("command"), F.get_json_object("input", "$.file_path").alias("file_path"), category.alias("category"))
    asks = (F.col("name") == "Bash") & F.coalesce(F.col("command"), F.lit("")).rlike(rf"(^|[\s;&|/(]){re.escape(graph_tool)}\s")
    c = c.withColumn("asks_graph", asks).withColumn("is_edit", F.col("name").isin(*EDIT_TOOLS) | F.coalesce(F.col("category") == "edit", F.lit(False)))
    return c.withColumn("call", F.row_number().over(Window.partitionBy("run").orderBy("seq", "pos")))


def transcript_metrics(lines: DataFrame, graph_tool: str = "depscape") -> DataFrame:
    """One row a run: round trips (messages of the main thread), calls by tool and shell category, calls before the first
    edit, files read by tool, searches after the first complete answer, answers given by hooks, stale results, and
    the sums and last values of result events.  Runs without any event have no row."""
    e = events_of(lines)
    calls = transcript_calls(lines, graph_tool)
    b = blocks_of(e)
    order = F.struct("seq", "pos")
    results = b.filter("event = 'user' and type = 'tool_result'").withColumn("text", block_text(F.col("content")))
    asked = calls.filter("asks_graph and id is not null").groupBy("run", F.col("id").alias("tool_use_id")).agg(F.min(F.struct("seq", "pos")).alias("asked"))
    results = results.join(asked, ["run", "tool_use_id"], "left")
    by_graph = F.coalesce(F.col("asked") < order, F.lit(False))
    complete = answer_is_complete(F.coalesce("text", F.lit("")))
    hooked = complete & ~by_graph & F.coalesce("is_error", F.lit(False))
    stale = F.coalesce(F.col("content"), F.lit("")).rlike(r'\\*"stale\\*": true')
    answers = results.groupBy("run").agg(
        F.min(F.when((complete & by_graph) | hooked, order)).alias("complete_at"), F.count_if(hooked).alias("hook_answers"), F.count_if(stale).alias("stale_results")
    )
    searching = F.col("name").isin("Grep", "Glob") | F.coalesce(F.col("category").isin("search", "list"), F.lit(False))
    joined = calls.join(answers, "run", "left")
    root = e.filter("type = 'system' and subtype = 'init'").groupBy("run").agg(F.regexp_replace(F.max_by("cwd", "seq"), "/+$", "").alias("root"))
    joined = joined.join(root, "run", "left")
    below = F.startswith("file_path", F.concat("root", F.lit("/"))) & (F.col("root") != "")
    read = F.when(F.coalesce(below, F.lit(False)), F.expr("substr(file_path, length(root) + 2)")).otherwise(F.col("file_path"))
    per = joined.groupBy("run").agg(
        F.count("*").alias("tool_calls"), F.count_if("nested").alias("subagent_calls"), F.min(F.when(F.col("is_edit"), F.col("call") - 1)).alias("calls_before_first_edit"),
        F.array_sort(F.collect_set(F.when(F.col("name") == "Read", F.nullif(read, F.lit(""))))).alias("files_read"),
        F.count_if(searching & ~F.col("nested") & (F.struct("seq", "pos") > F.col("complete_at"))).alias("after"),
    )
    count = lambda key, name: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name)
    tools = calls.groupBy("run", "name").agg(F.count("*").alias("n")).groupBy("run").agg(count("name", "tools"))
    shell = calls.filter("category is not null").groupBy("run", "category").agg(F.count("*").alias("n")).groupBy("run").agg(count("category", "shell"))
    main = (F.col("type") == "assistant") & F.col("parent_tool_use_id").isNull()
    trip = F.coalesce(F.col("message.id"), F.concat(F.lit("anon-"), F.col("seq").cast("string")))
    done = F.col("type") == "result"
    last = lambda c, name: F.max_by(F.struct(F.col(c).alias("v")), F.when(done, F.col("seq")))["v"].alias(name)
    base = e.groupBy("run").agg(
        F.count_distinct(F.when(main, trip)).alias("round_trips"), F.count_if(done).alias("result_events"), F.sum(F.when(done, F.coalesce("num_turns", F.lit(0)))).alias("num_turns"),
        F.sum(F.when(done, F.coalesce("duration_ms", F.lit(0)))).alias("duration_ms"), last("total_cost_usd", "cost_usd"), last("is_error", "is_error"), last("subtype", "stop_reason"),
        F.coalesce(last("result", "r"), F.lit("")).alias("final_text"), last("usage.input_tokens", "input_tokens"), last("usage.output_tokens", "output_tokens"),
        last("usage.cache_read_input_tokens", "cache_read_tokens"), last("usage.cache_creation_input_tokens", "cache_creation_tokens"),
    )
    out = base.join(per, "run", "left").join(answers, "run", "left").join(tools, "run", "left").join(shell, "run", "left")
    none = F.lit(0).cast("long")
    return out.select(
        *base.columns, F.coalesce("tool_calls", none).alias("tool_calls"), F.coalesce("subagent_calls", none).alias("subagent_calls"), "calls_before_first_edit",
        F.coalesce("files_read", F.array().cast("array<string>")).alias("files_read"), F.coalesce("tools", F.create_map().cast("map<string,bigint>")).alias("tools"),
        F.coalesce("shell", F.create_map().cast("map<string,bigint>")).alias("shell"), F.col("complete_at").isNotNull().alias("complete"),
        F.when(F.col("complete_at").isNotNull(), F.coalesce("after", none)).alias("searches_after_complete"), F.coalesce("hook_answers", none).alias("hook_answers"),
        F.coalesce("stale_results", none).alias("stale_results"),
    )


# --- what shell commands read ---

#: Separators of a command's parts.
_PARTS = re.compile(r"&&|\|\||[;|\n]")


class _Shell:
    """A working directory below a root, moved by the commands of a run in order."""

    def __init__(self, root: str, known: frozenset[str]):
        self.root, self.known, self.cwd = root.rstrip("/"), known, "."

    def place(self, path: str, base: str) -> str | None:
        """A path relative to the root; None outside of it."""
        if path == self.root or path.startswith(self.root + "/"):
            return posixpath.normpath(path[len(self.root) :].lstrip("/") or ".")
        return None if path.startswith("/") else posixpath.normpath(posixpath.join(base, path))

    def words(self, part: str) -> list[str]:
        try:
            return shlex.split(part)
        except ValueError:
            return part.split()

    def run(self, command: str) -> set[str]:
        """Known files that the command reads; moves the working directory."""
        found = set()
        for part in _PARTS.split(command.partition("<<")[0]):
            head, *rest = self.words(part.strip().lstrip("( ").rstrip(") ")) or [""]
            head = head.rpartition("/")[2]
            if head == "cd" and rest:
                self.cwd = self.place(rest[0], self.cwd) or self.cwd
            elif head in READERS or (head == "git" and rest[:1] == ["grep"]):
                for word in rest:
                    if word[:1] != "-" and not set(word) & set("*?[]{}$"):
                        places = (self.place(word, base) for base in (self.cwd, "."))
                        found |= set([p for p in places if p in self.known][:1])
        return found


def shell_reads(lines: DataFrame, known: DataFrame) -> DataFrame:
    """run, seq, pos, cwd (before the command) and reads (sorted known files) of the main thread's shell commands.

    ``known``: run, path.  A run's commands and files are one session's, so a run is one group."""
    calls = transcript_calls(lines).filter("name = 'Bash' and not nested").select("run", "seq", "pos", F.coalesce("command", F.lit("")).alias("command"))
    root = events_of(lines).filter("type = 'system' and subtype = 'init'").groupBy("run").agg(F.max_by("cwd", "seq").alias("root"))
    files = known.groupBy("run").agg(F.collect_set("path").alias("known"))

    def go(calls: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        calls = calls.sort_values(["seq", "pos"])
        a = about.iloc[0] if len(about) else None
        shell = _Shell((a["root"] or "") if a is not None else "", frozenset(a["known"] if a is not None and a["known"] is not None else ()))
        rows = []
        for run, seq, pos, command in calls.itertuples(index=False):
            rows.append((run, seq, pos, shell.cwd, sorted(shell.run(command))))
        return pd.DataFrame(rows, columns=["run", "seq", "pos", "cwd", "reads"])

    about = root.join(files, "run", "left").select(F.col("run").alias("of"), "root", "known")
    return calls.groupBy("run").cogroup(about.groupBy("of")).applyInPandas(go, "run string, seq long, pos int, cwd string, reads array<string>")
