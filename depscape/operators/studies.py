"""Reports over replayed commands, mined commits, task statements and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import is_test_path

# Definitions on changed lines and elsewhere, hunk headers, file names that tell nothing; limits of mining.
CHANGED_DEF = r"^([+-])\s*(?:async\s+)?def\s+(\w+)\s*\((.*)"
DEFINITION = r"^\s*(?:(?:async\s+)?def|class)\s+(\w+)"
HUNK = r"^@@ [^@]* @@\s*(.*)$"
GENERIC_NAMES = ("__init__.py", "pyproject.toml", "uv.lock", "README.md", "CHANGELOG.md", "CLAUDE.md", "conftest.py", "Makefile")
MOST_FILES, LEAST_CALLER_FILES = 15, 2
#: A record's longest answer, and the longest record, in bytes.
ANSWER_BYTES, RECORD_BYTES = 20_000, 200_000


# --- replays ---


def replay_report(decisions: DataFrame) -> DataFrame:
    """One row a build: rewritten and passed commands, bytes of both ways over the rewritten ones and their ratio (0 if
    nothing), exit codes that differ, searches, their sites, lost sites and missing headers.

    ``decisions``: build, rewrite, reason, hook_bytes, plain_bytes, hook_code, plain_code, searches (array of
    struct<sites, lost, header_ok>, null where none)."""
    r = F.col("rewrite")
    s = F.when(r, F.coalesce("searches", F.array().cast(decisions.schema["searches"].dataType)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    over = lambda f: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + f(x))
    out = decisions.groupBy("build").agg(
        F.count_if(r).alias("rewritten"), F.count_if(~r).alias("passed"), total(F.when(r, F.col("hook_bytes"))).alias("hook_bytes"), total(F.when(r, F.col("plain_bytes"))).alias("plain_bytes"),
        F.count_if(r & (F.col("hook_code") != F.col("plain_code"))).alias("mismatches"), total(F.size(s)).alias("searches"), total(over(lambda x: x["sites"])).alias("sites"),
        total(over(lambda x: x["lost"])).alias("lost"), total(over(lambda x: F.when(x["header_ok"], F.lit(0)).otherwise(F.lit(1)))).alias("no_header"),
    )
    return out.withColumn("ratio", F.when(F.col("plain_bytes") > 0, F.col("hook_bytes") / F.col("plain_bytes")).otherwise(0.0))


def passed_reasons(decisions: DataFrame) -> DataFrame:
    """build, reason, n: why commands were passed through."""
    return decisions.filter("not rewrite").groupBy("build", "reason").agg(F.count("*").alias("n"))


def same_file(a: Column, b: Column) -> Column:
    """Whether one path ends with the other, leading dots and slashes aside."""
    a, b = (F.regexp_replace(x, "^[./]+", "") for x in (a, b))
    return F.endswith(a, b) | F.endswith(b, a)


# --- commits ---


def diff_rows(diffs: DataFrame) -> DataFrame:
    """sha, n, line, path of each line of unified diffs (sha, diff); path: the new file that the line is in."""
    rows = diffs.select("sha", F.posexplode(F.split("diff", "\n")).alias("n", "line"))
    new = F.when(F.startswith("line", F.lit("+++ b/")), F.expr("substr(line, 7)"))
    return rows.withColumn("path", F.last(new, ignorenulls=True).over(Window.partitionBy("sha").orderBy("n")))


def changed_definitions(rows: DataFrame) -> DataFrame:
    """sha, name of functions whose signature a commit changes: both removed and added, last ones of the name differ.
    Names that begin with two underscores don't count."""
    part = lambda i: F.regexp_extract("line", CHANGED_DEF, i)
    d = rows.filter(F.col("line").rlike(CHANGED_DEF)).select("sha", "n", part(1).alias("sign"), part(2).alias("name"), F.trim(part(3)).alias("rest"))
    last = lambda sign: F.max_by("rest", F.when(F.col("sign") == sign, F.col("n")))
    both = d.groupBy("sha", "name").agg(last("-").alias("old"), last("+").alias("new"))
    return both.filter("old is not null and new is not null and old <> new and name not like '\\\\_\\\\_%'").select("sha", "name")


def mined_commits(diffs: DataFrame, most_files: int = MOST_FILES, least_callers: int = LEAST_CALLER_FILES) -> DataFrame:
    """sha, names (sorted), files, caller_files: commits that change signatures and touch calls of them in at least
    ``least_callers`` files, with at most ``most_files`` files.

    Calls are found by exploding the called names of added lines once and joining them with the changed names, not by
    a pattern for each name."""
    rows = diff_rows(diffs)
    changed = changed_definitions(rows)
    added = rows.filter(F.startswith("line", F.lit("+")) & ~F.startswith("line", F.lit("+++ b/")) & ~F.col("line").rlike(CHANGED_DEF))
    called = added.select("sha", "path", F.explode(F.regexp_extract_all("line", F.lit(r"\b(\w+)\("), F.lit(1))).alias("name"))
    callers = called.join(changed, ["sha", "name"], "left_semi").groupBy("sha").agg(F.count_distinct("path").alias("caller_files"))
    files = rows.groupBy("sha").agg(F.count_distinct(F.when(F.endswith("path", F.lit(".py")), F.col("path"))).alias("files"))
    names = changed.groupBy("sha").agg(F.array_sort(F.collect_set("name")).alias("names"))
    out = names.join(callers, "sha").join(files, "sha")
    return out.filter((F.col("caller_files") >= least_callers) & (F.col("files") <= most_files)).select("sha", "names", "files", "caller_files")


def touched(rows: DataFrame) -> DataFrame:
    """sha, kind (path or symbol), name: paths of a diff, and definitions on its changed lines or in its hunk headers."""
    paths = rows.filter("path is not null").select("sha", F.lit("path").alias("kind"), F.col("path").alias("name"))
    code = rows.filter(F.endswith("path", F.lit(".py")) & ~F.col("line").rlike(r"^(--- |\+\+\+ |diff --git)"))
    text = F.when(F.col("line").rlike(HUNK), F.regexp_extract("line", HUNK, 1)).when(F.col("line").rlike("^[+-]"), F.expr("substr(line, 2)"))
    name = F.regexp_extract(text, DEFINITION, 1)
    symbols = code.select("sha", F.lit("symbol").alias("kind"), name.alias("name")).filter("name <> ''").filter(~F.col("name").rlike("^(__|test_|Test)"))
    return paths.unionByName(symbols).distinct()


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def leaks(statements: DataFrame, parts: DataFrame) -> DataFrame:
    """sha, kind (path, file or symbol), name: what a task's statement (sha, statement) gives away of its diff.

    A path or a file name that isn't generic counts where it stands alone; a name with an underscore or a capital too;
    a plain word only where it is written as code."""
    p = parts.join(statements, "sha")
    base = F.element_at(F.split("name", "/"), -1)
    has = lambda before, what, after: F.regexp_like("statement", F.concat(F.lit(before), _quoted(what), F.lit(after)))
    whole = F.contains("statement", F.col("name"))
    named = ~base.isin(*GENERIC_NAMES) & has(r"(?<![\w.-])", base, r"\b")
    bare = F.regexp_replace("name", "^_+", "")
    telling = lambda f: F.contains(F.regexp_replace(f, "^_+|_+$", ""), F.lit("_")) | F.startswith(f, F.lit("_")) | f.rlike("[A-Z]")
    word = lambda f: has(r"(?<![\w-])", f, r"(?![\w-])")
    coded = lambda f: has("`", f, "`") | has(r"(?<![\w-])", f, r"\(")
    symbol = lambda f: (f != "") & F.when(telling(f), word(f)).otherwise(coded(f))
    is_path = F.col("kind") == "path"
    kind = F.when(is_path & whole, F.lit("path")).when(is_path & named, F.lit("file")).when(~is_path & (symbol(F.col("name")) | symbol(bare)), F.lit("symbol"))
    return p.select("sha", kind.alias("kind"), F.when(is_path & ~whole, base).otherwise(F.col("name")).alias("name")).filter("kind is not null").distinct()


# --- truth of questions ---

#: Python's strings and comments, longest first.
STRINGS_AND_COMMENTS = r"(?s)[rbfuRBFU]{0,2}\"\"\".*?\"\"\"|[rbfuRBFU]{0,2}'''.*?'''|[rbfuRBFU]{0,2}\"(?:[^\"\\\n]|\\.)*\"|[rbfuRBFU]{0,2}'(?:[^'\\\n]|\\.)*'|#[^\n]*"


def called_names(source: Column) -> Column:
    """Distinct names followed by a parenthesis in code, strings and comments aside; a definition's name is one too."""
    code = F.regexp_replace(source, STRINGS_AND_COMMENTS, '""')
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?<!\w)([A-Za-z_]\w*)[ \t]*\("), F.lit(1)))


def question_truth(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, path, role for files (path, text) that name a symbol with a parenthesis: defined_in, callers,
    test_callers, or mentioned_only where all is in strings and comments.  A file may define and call."""
    mention = files.select("path", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)\("), F.lit(1)))).alias("symbol"))
    m = mention.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    of = lambda pattern: F.regexp_count("text", F.concat(F.lit(pattern), _quoted(F.col("symbol")), F.lit(r"\(")))
    defs = of(r"(?m)^\s*(?:async\s+)?def\s+")
    lines = of(r"(?m)^(?!\s*(?:async\s+)?def\s).*?(?<!\w)") > 0
    calls = F.array_contains(called_names(F.regexp_replace("text", r"(?m)^(\s*(?:async\s+)?def\s+)\w+\(", "$1(")), F.col("symbol"))
    role = F.when(~calls, F.lit("mentioned_only")).when(is_test_path("path"), F.lit("test_callers")).otherwise(F.lit("callers"))
    roles = F.array_compact(F.array(F.when(defs > 0, F.lit("defined_in")), F.when(lines, role)))
    return m.select("symbol", "path", F.explode(roles).alias("role"))


# --- benchmark runs ---


def best_variants(metrics: DataFrame, measure: str) -> DataFrame:
    """engine, size, variant, value: each engine's fastest variant by a measure among the correct ones, all if none is.

    ``metrics``: engine, size, variant, metric, value; a variant is correct where its metric ``correct`` is 1."""
    per = metrics.groupBy("engine", "size", "variant").agg(
        F.max(F.when(F.col("metric") == "correct", F.col("value"))).alias("correct"), F.min(F.when(F.col("metric") == measure, F.col("value"))).alias("value")
    )
    wrong = ~F.coalesce(F.col("correct") == 1, F.lit(False))
    key = F.struct(wrong.alias("wrong"), F.coalesce("value", F.lit(1e18)).alias("value"), "variant")
    best = per.groupBy("engine", "size").agg(F.min_by(F.struct("variant", "value"), key).alias("b"))
    return best.select("engine", "size", "b.variant", "b.value")


def shown_time(us: Column) -> Column:
    """Microseconds for a report: milliseconds from 1,000 on, one decimal below 10; a dash for null."""
    tenth = lambda x, unit: F.format_string("%.1f " + unit, x)
    return F.when(us.isNull(), F.lit("—")).when(us >= 1000, tenth(us / 1000, "ms")).when(us >= 10, F.format_string("%.0f µs", F.bround(us, 0))).otherwise(tenth(us, "µs"))


def attribution_counts(runs: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """used, runs and the median of each measure, nulls aside, for runs by what the answers did."""
    return runs.groupBy("used").agg(F.count("*").alias("runs"), *[F.median(m).alias(m) for m in measures])


def recounted(records: DataFrame, turns: DataFrame) -> DataFrame:
    """Records (run_id, num_turns, ...) with their turns counted again (run_id, num_turns); what changed is kept in
    turns_recounted_from."""
    new = turns.select("run_id", F.col("num_turns").alias("_new"))
    out = records.join(new, "run_id", "left")
    old, now = F.col("num_turns"), F.coalesce("_new", "num_turns")
    return out.withColumn("turns_recounted_from", F.when(~now.eqNullSafe(old), old)).withColumn("num_turns", now).drop("_new")


# --- the event log ---


def cut_bytes(text: Column, most: int = ANSWER_BYTES) -> Column:
    """The longest start of a text that takes at most ``most`` bytes of UTF-8: a character that the cut would split goes."""
    raw = F.encode(text, "UTF-8")
    byte = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int")
    inside = lambda at: byte(at).bitwiseAND(192) == 128
    back = F.when(~inside(most + 1), 0).when(~inside(most), 1).when(~inside(most - 1), 2).otherwise(3)
    cut = F.decode(F.substr(raw, F.lit(1), F.lit(most) - back), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(cut)


def log_records(events: DataFrame) -> DataFrame:
    """Events as the log keeps them: answers cut, records over the limit left out and marked."""
    big = F.coalesce(F.octet_length("record") > RECORD_BYTES, F.lit(False))
    out = events.withColumn("record_omitted", F.when(big, F.lit(True))).withColumn("record", F.when(~big, F.col("record")))
    return out.withColumn("answer", cut_bytes(F.col("answer")))


def append_log(events: DataFrame, path: str) -> None:
    """Appends events to a log of JSON lines that ``sources.tree`` reads back; null fields aren't written."""
    log_records(events).write.mode("append").json(path)
