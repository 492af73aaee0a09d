"""Finding symbols by reference: id, qualified name, suffix or plain name.  Never guesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import last_segment

MAX_CANDIDATES = 20


def lookup(symbols: DataFrame, refs: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """For each distinct ``ref``: status (found, ambiguous, not_found), n (all matches) and, in order of
    qualified name, path and id, at most ``most`` candidates (rank, id, qualified, path).

    A reference of 32 hex digits that is an id is that symbol.  Otherwise candidates have its last segment
    as name; a dotted one must equal the qualified name, or else end it at a separator.
    """
    asked = refs.select("ref").distinct().withColumn("q", F.trim("ref")).withColumn("name", last_segment("q"))
    s = symbols.select("id", "name", "qualified", "path")
    by_id = asked.filter(F.col("q").rlike("^[0-9a-f]{32}$")).join(s.drop("name"), F.col("q") == F.col("id")).select("ref", "id", "qualified", "path")
    rest = asked.join(by_id.select("ref"), "ref", "left_anti")
    m = rest.join(s, "name")
    exact = F.col("qualified") == F.col("q")
    suffix = F.endswith("qualified", F.concat(F.lit("."), F.col("q"))) | F.endswith("qualified", F.concat(F.lit("::"), F.col("q")))
    dotted = F.col("q") != F.col("name")
    m = m.withColumn("fit", F.when(~dotted | exact, 2).when(suffix, 1).otherwise(0)).filter("fit > 0")
    m = m.withColumn("best", F.max("fit").over(Window.partitionBy("ref"))).filter("fit = best")
    m = m.select("ref", "id", "qualified", "path").unionByName(by_id)
    per = Window.partitionBy("ref")
    m = m.withColumn("rank", F.row_number().over(per.orderBy("qualified", "path", "id"))).withColumn("n", F.count("*").over(per))
    out = refs.select("ref").distinct().join(m.filter(F.col("rank") <= most), "ref", "left")
    status = F.when(F.col("n").isNull(), F.lit("not_found")).when(F.col("n") == 1, F.lit("found")).otherwise(F.lit("ambiguous"))
    return out.select("ref", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), "rank", "id", "qualified", "path")


def symbols_by_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    return symbols.join(names.select("name").distinct(), "name", "left_semi")


def symbols_in_files(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    return symbols.join(paths.select("path").distinct(), "path", "left_semi")


def symbols_by_id(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    return symbols.join(ids.select("id").distinct(), "id", "left_semi")


def sites_into(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Every resolved reference into the symbols (``id``), a row each, with its order within the symbol."""
    from ..model import EDGE_KINDS, PROVENANCES, ordinal

    e = links.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    w = Window.partitionBy("dst").orderBy("src", ordinal(F.col("kind"), EDGE_KINDS), ordinal(F.col("prov"), PROVENANCES), "site_line")
    return e.withColumn("rank", F.row_number().over(w)).select("dst", "rank", "src", "kind", "prov", "site_line")


def callers(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(dst, src, kind, prov) for each edge into the symbols."""
    return links.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("dst", "src", "kind", "prov")


def callees(resolution: DataFrame, ids: DataFrame) -> DataFrame:
    """Every edge that leaves the symbols, whatever its outcome."""
    return resolution.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def source_block(files: DataFrame, symbols: DataFrame, cap: int = 4096) -> DataFrame:
    """id, text, truncated: the lines of each symbol, each behind its number, whole lines up to ``cap`` bytes.

    ``files``: (path, text)."""
    joined = symbols.select("id", "path", "start_line", "end_line").join(files.select("path", "text"), "path")
    body = F.slice(F.split("text", "\n"), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    numbered = F.transform(body, lambda line, i: F.concat((F.col("start_line") + i).cast("string"), F.lit("| "), line))
    # Bytes up to and with each line, its line break included.
    upto = F.aggregate(
        numbered,
        F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.octet_length(x) + 1)),
    )
    kept = F.size(F.filter(upto, lambda n: n <= cap + 1))
    return joined.select("id", F.array_join(F.slice(numbered, F.lit(1), kept), "\n").alias("text"), (kept < F.size(numbered)).alias("truncated"))
