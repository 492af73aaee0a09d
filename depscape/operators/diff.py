"""Diffs: unified diff text to hunks, hunks to symbols, and what the change reaches."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import DEPENDENCY_KINDS
from . import impact, traverse


def parse_diff(diffs: DataFrame) -> DataFrame:
    """``diffs`` (diff_id, text) to diff_id, seq, path, start_line, line_count: new-side ranges of every hunk.

    Files that the diff deletes give none; a count that isn't written is 1."""
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    target = F.trim(F.substring("line", 5, 1 << 30))
    path = F.when(F.startswith("line", F.lit("+++ ")), F.when(target == "/dev/null", F.lit("")).otherwise(F.regexp_replace(target, "^b/", "")))
    w = Window.partitionBy("diff_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    hunk = r"^@@ (?:.*?\s)?\+(\d+)(?:,(\d+))?"
    out = lines.withColumn("path", F.last(path, ignorenulls=True).over(w)).filter(F.startswith("line", F.lit("@@ ")) & (F.length("path") > 0))
    count = F.nullif(F.regexp_extract("line", hunk, 2), F.lit(""))
    start = F.nullif(F.regexp_extract("line", hunk, 1), F.lit(""))
    return out.filter(F.col("line").rlike(r"\s\+")).select(
        "diff_id", "seq", "path", F.coalesce(start.cast("int"), F.lit(0)).alias("start_line"), F.coalesce(count.cast("int"), F.lit(1)).alias("line_count")
    )


def git_diff(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """Hunks of a working tree against ``base``; runs git on the driver."""
    done = subprocess.run(["git", "diff", "-U0", "--no-color", "--no-ext-diff", base, "--"], cwd=root, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip())
    return parse_diff(spark.createDataFrame([(root, done.stdout.decode("utf-8", "replace"))], "diff_id string, text string"))


def hunk_range(hunks: DataFrame) -> DataFrame:
    """Adds lo, hi: the lines a hunk covers; a pure deletion covers one."""
    lo = F.greatest("start_line", F.lit(1))
    return hunks.withColumn("lo", lo).withColumn("hi", lo + F.greatest("line_count", F.lit(1)) - 1)


def innermost(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """hunk_id, path, id, lo, hi: the symbols each hunk overlaps, without those that contain another overlapped
    symbol of fewer lines; the range is clipped to the symbol.  ``hunks``: hunk_id, path, start_line, line_count."""
    h = hunk_range(hunks).select("hunk_id", "path", "lo", "hi")
    s = symbols.select("id", "path", F.col("start_line").alias("s0"), F.col("end_line").alias("s1"))
    hit = h.join(s, "path").filter((F.col("s0") <= F.col("hi")) & (F.col("s1") >= F.col("lo")))
    # Within a hunk a symbol goes if an overlapped one with a shorter span lies inside it.
    of_hunk = F.collect_list(F.struct("id", "s0", "s1")).over(Window.partitionBy("hunk_id"))
    inside = F.exists(
        "all",
        lambda t: (t["id"] != F.col("id")) & (t["s0"] >= F.col("s0")) & (t["s1"] <= F.col("s1")) & ((t["s1"] - t["s0"]) < (F.col("s1") - F.col("s0"))),
    )
    return hit.withColumn("all", of_hunk).filter(~inside).select("hunk_id", "path", "id", F.greatest("lo", "s0").alias("lo"), F.least("hi", "s1").alias("hi"))


def unmapped(symbols: DataFrame, hunks: DataFrame, mapped: DataFrame) -> DataFrame:
    """Hunks without a symbol, and why."""
    known = symbols.select("path").distinct().withColumn("known", F.lit(True))
    rest = hunks.join(mapped.select("hunk_id").distinct(), "hunk_id", "left_anti").join(known, "path", "left")
    reason = F.when(F.col("known"), F.lit("outside any indexed symbol")).otherwise(F.lit("file not indexed"))
    return rest.select("hunk_id", "path", "start_line", "line_count", reason.alias("reason"))


def diff_impact(symbols: DataFrame, links: DataFrame, resolution: DataFrame, raw_edges: DataFrame, hunks: DataFrame, depth: int = 3) -> dict[str, DataFrame]:
    """What one diff reaches, as named tables.

    changed: each changed symbol with its ranges, direct production and test callers, gaps and risk.
    unmapped: hunks without symbol.  dependents: ranked dependents of all changed symbols together.
    risk: of the whole.  covering_tests: changed tests and tests among the dependents.  tests: tests that
    reach a changed symbol through calls and references.  indirect: groups at depth 2 or more.
    sites, overrides: per changed symbol."""
    hit = innermost(symbols, hunks)
    changed = hit.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    info = symbols.select("id", "name", "qualified", "kind", "path", "start_line", "is_test")
    changed = changed.join(info, "id")
    own = changed.select(F.col("id").alias("query"), "id", "name")
    all_roots = changed.select(F.lit("diff").alias("query"), "id")
    e = links.filter(F.col("kind").isin(*DEPENDENCY_KINDS) & (F.col("kind") != "imports") & (F.col("src") != F.col("dst")))
    direct = e.join(changed.select(F.col("id").alias("dst")), "dst", "left_semi").select("dst", "src").distinct()
    direct = direct.join(symbols.select(F.col("id").alias("src"), F.col("is_test").alias("t")), "src")
    counts = direct.groupBy(F.col("dst").alias("id")).agg(F.count_if(~F.col("t")).alias("direct_prod"), F.count_if(F.col("t")).alias("direct_test"))
    gaps = impact.name_gaps(resolution, raw_edges, own).select(F.col("query").alias("id"), (F.col("ambiguous") + F.col("unresolved")).alias("gaps"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    changed = changed.join(counts, "id", "left").join(gaps, "id", "left").select(*changed.columns, zero("direct_prod"), zero("direct_test"), zero("gaps"))
    changed = changed.withColumn("risk", impact.risk_level(F.col("direct_prod"), F.col("direct_prod"), F.col("gaps")))
    reached, beyond = traverse.dependents(links, all_roots, depth)
    ranked = impact.ranked_dependents(reached, symbols, links)
    total = all_roots.select("query").distinct().join(impact.summary(reached, symbols), "query", "left").na.fill(0)
    total = total.crossJoin(changed.agg(F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps")))  # one row each
    own_tests = changed.filter("is_test").select("id", F.lit(0).alias("depth"), "qualified")
    covering = own_tests.unionByName(ranked.filter("is_test and symbol_kind in ('function', 'method', 'class')").select("id", "depth", "qualified"))
    targets = changed.select(F.col("id").alias("target"))
    tests = traverse.covering_tests(links, symbols, targets, max(depth, 3)).groupBy("id").agg(F.min("depth").alias("depth"))
    sites = impact.site_rank(impact.direct_sites(links, symbols, own.select("query", "id")))
    return {
        "changed": changed, "unmapped": unmapped(symbols, hunks, hit), "dependents": ranked, "beyond": beyond, "risk": impact.assess(total),
        "covering_tests": covering, "tests": tests, "indirect": impact.indirect_groups(ranked), "sites": sites,
        "overrides": traverse.overrides(links, symbols, changed.select("id")),
    }


def changed_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, path, sign, line: added and removed lines with the file they belong to."""
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    path = F.when(F.startswith("line", F.lit("diff --git ")), F.regexp_extract("line", r" b/(.*)$", 1))
    w = Window.partitionBy("diff_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    body = lines.withColumn("path", F.last(path, ignorenulls=True).over(w)).filter(F.col("line").rlike(r"^[+-]") & ~F.col("line").rlike(r"^(\+\+\+|---) "))
    return body.select("diff_id", "seq", "path", F.substring("line", 1, 1).alias("sign"), F.substring("line", 2, 1 << 30).alias("line"))


def new_files(diffs: DataFrame) -> DataFrame:
    """diff_id, path: files that a diff creates."""
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    w = Window.partitionBy("diff_id").orderBy("seq")
    made = lines.withColumn("old", F.lag("line").over(w)).filter(F.startswith("line", F.lit("+++ b/")) & (F.col("old") == "--- /dev/null"))
    return made.select("diff_id", F.substring("line", 7, 1 << 30).alias("path"))
