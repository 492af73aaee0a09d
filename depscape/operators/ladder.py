"""Resolution by widening scopes: file, directory, unit, repository; the first scope with a candidate decides.

Also units (the nearest ancestor directory with a manifest) and import specifiers to files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import basename, dirname

SCOPES = ("file", "dir", "unit", "repo")
MANIFESTS = ("Cargo.toml", "pyproject.toml", "setup.py", "package.json", "go.mod")


def units(paths: DataFrame) -> DataFrame:
    """path, unit: the nearest directory at or above each file that holds a manifest; "" if none."""
    held = paths.filter(basename("path").isin(*MANIFESTS)).select(dirname("path").alias("unit")).distinct()
    parts = F.split("path", "/")
    up = paths.select("path", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("n"))
    up = up.select("path", F.when(F.col("n") == 0, F.lit(".")).otherwise(F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("n")), "/")).alias("unit"))
    best = up.join(held, "unit").groupBy("path").agg(F.max_by("unit", F.when(F.col("unit") == ".", 0).otherwise(F.length("unit") + 1)).alias("unit"))
    return paths.select("path").distinct().join(best, "path", "left").withColumn("unit", F.coalesce("unit", F.lit("")))


def ladder(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """ref, outcome, dst, candidates, scope for each reference (ref, name, path, unit).

    ``definitions``: id, name, path, unit.  Definitions are counted by name and scope first, so a reference meets one row
    a scope, however many share its name; references alike in name, path and unit are decided once."""
    r = refs.select("ref", "name", F.col("path").alias("rp"), F.col("unit").alias("ru"))
    alike = ["name", "rp", "ru"]
    own = r.select(*alike).distinct()
    levels = (F.col("rp"), dirname("rp"), F.when(F.col("ru") != "", F.col("ru")), F.lit(""))
    at = own.select(*alike, F.posexplode(F.array(*levels)).alias("s", "at"))
    places = (F.col("path"), dirname("path"), F.when(F.col("unit") != "", F.col("unit")), F.lit(""))
    d = definitions.filter("id is not null").select("name", "id", F.posexplode(F.array(*places)).alias("s", "at")).filter("at is not null")
    found = d.groupBy("name", "s", "at").agg(F.count_distinct("id").alias("n"), F.min("id").alias("d"))
    hit = at.join(found, ["name", "s", "at"]).groupBy(*alike).agg(F.min(F.struct("s", "n", "d")).alias("b"))
    hit = hit.select("b", *[F.col(c).alias(f"_{c}") for c in alike])
    same = F.lit(True)
    for c in alike:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    best = r.join(hit, same, "left").groupBy("ref").agg(F.min("b").alias("b"))
    names = F.array(*[F.lit(x) for x in SCOPES])
    return best.select(
        "ref", F.when(F.col("b").isNull(), F.lit("unresolved")).when(F.col("b.n") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous")).alias("outcome"),
        F.when(F.col("b.n") == 1, F.col("b.d")).alias("dst"), F.coalesce("b.n", F.lit(0)).alias("candidates"), F.get(names, F.col("b.s")).alias("scope"),
    )


def module_files(specs: DataFrame, paths: DataFrame) -> DataFrame:
    """spec, path: files that a dotted Python import path names: the module's file or its package, at any root."""
    stem = F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), r"/__init__$", "")
    parts = paths.filter(F.col("path").rlike(r"\.pyi?$")).select("path", F.split(stem, "/").alias("p"))
    tails = parts.select("path", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"), "p")
    tails = tails.select("path", F.array_join(F.slice("p", F.col("i"), F.size("p") - F.col("i") + 1), ".").alias("spec"))
    return specs.select("spec").distinct().join(tails, "spec").select("spec", "path")
