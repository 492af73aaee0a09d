"""Column expressions used throughout: path and name functions, ranks, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MODULE, WILDCARD


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dirname(path: Column | str) -> Column:
    """Directory of a path; "." at the root."""
    p = _c(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def last_segment(name: Column | str) -> Column:
    """After the last ``::`` and then the last dot."""
    return F.element_at(F.split(F.element_at(F.split(_c(name), "::"), -1), r"\."), -1)


def import_head(path: Column | str) -> Column:
    """First segment of an in-repository import path; null for external or no path."""
    p = _c(path)
    return F.when(~F.startswith(p, F.lit("<external>:")), F.regexp_extract(p, r"^[^.:]+", 0))


def key_name(name: Column | str, import_path: Column | str) -> Column:
    n, p = _c(name), _c(import_path)
    return F.when(n.isin(MODULE, WILDCARD) & p.isNotNull(), F.element_at(F.split(p, r"[.:]+"), -1)).otherwise(n)


def module_qualified(path: Column | str) -> Column:
    """Dotted module name of a file path; a package's ``__init__`` collapses to the package."""
    stem = F.regexp_replace(F.regexp_replace(_c(path), r"^\./", ""), r"\.pyi?$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"(.)/__init__$", "$1"), "/", ".")


def is_test_path(path: Column | str) -> Column:
    p = _c(path)
    stem = F.regexp_replace(basename(p), r"\.pyi?$", "")
    return p.rlike(r"(^|/)tests?/") | stem.rlike(r"^test_|_test$|^conftest$")


def local_name(qualified: Column | str, path: Column | str) -> Column:
    """Name within its file: the qualified name without the module's part."""
    q, m = _c(qualified), module_qualified(path)
    inside = F.startswith(q, F.concat(m, F.lit(".")))
    return F.when(inside & (F.length(m) > 0), F.substr(q, F.length(m) + 2)).otherwise(q)


def node_id(qualified: Column | str, path: Column | str) -> Column:
    """``path::A::b``, as test runners take it."""
    return F.concat(_c(path), F.lit("::"), F.replace(local_name(qualified, path), F.lit("."), F.lit("::")))


def shared_dirs(a: Column | str, b: Column | str) -> Column:
    """Number of leading path segments two paths share, the file name included."""
    same = F.zip_with(F.split(_c(a), "/"), F.split(_c(b), "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long")).cast("int")


def common_dir(paths: Column | str) -> Column:
    """Longest directory that all paths of an array are in; "" if none."""
    dirs = F.transform(_c(paths), lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1))

    def shared(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
        n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long")).cast("int")
        return F.slice(x, F.lit(1), n)

    return F.array_join(F.aggregate(F.slice(dirs, 2, F.greatest(F.size(dirs) - 1, F.lit(0))), F.element_at(dirs, 1), shared), "/")


def estimate_tokens(record: Column | str) -> Column:
    """A quarter of the record's JSON bytes, rounded up; null fields count."""
    return F.ceil(F.octet_length(F.to_json(_c(record), {"ignoreNullFields": "false"})) / 4)


def collapse_space(text: Column | str) -> Column:
    return F.regexp_replace(F.trim(_c(text)), r"\s+", " ")


def truncate(text: Column | str, most: int = 80) -> Column:
    t = collapse_space(text)
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def numbered(df: DataFrame, name: str, partition: list[str], *order: Column) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each partition, in the order given."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def nearest_rank(df: DataFrame, value: str, groups: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Exact percentiles by nearest rank, sorted[round((n - 1) * p)], for each group, plus n, max and mean.

    Values are counted first, so equal values take one row and no task sorts all rows of a large group
    unless its values are all different.
    """
    keys = [F.col(g) for g in groups]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_v")
    upto = counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))

    def pick(p: float) -> Column:
        at = F.floor((F.col("_all") - 1) * F.lit(p) + F.lit(0.5))
        return F.min(F.when(F.col("_to") > at, F.col("_v")))

    aggs = [pick(p).alias(f"p{p * 100:g}") for p in shares]
    return upto.groupBy(*keys).agg(
        F.first("_all").alias("n"), *aggs, F.max("_v").alias("max"), (F.sum(F.col("_v") * F.col("_n")) / F.first("_all")).alias("mean")
    )


def short_label(qualified: Column | str, kind: Column | str) -> Column:
    """``Class.method`` for a method, the last name otherwise."""
    parts = F.split(_c(qualified), r"\.")
    two = F.array_join(F.slice(parts, -2, 2), ".")
    return F.when((_c(kind) == "method") & (F.size(parts) > 1), two).otherwise(F.element_at(parts, -1))


def suffixed(df: DataFrame, base: str, name: str, *order: Column) -> DataFrame:
    """Adds ``name``: the base id, with ``~2``, ``~3``, ... from the second row of an id on, in the order given."""
    k = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(name, F.when(k == 1, F.col(base)).otherwise(F.concat(base, F.lit("~"), k.cast("string"))))


def to_hex(value: Column | str) -> Column:
    """Lower-case hex of a string's or binary's bytes."""
    return F.lower(F.hex(_c(value)))


def from_hex(value: Column | str) -> Column:
    return F.unhex(_c(value))


def tests_run_line(ids: Column | str) -> Column:
    """A ``pytest`` line for an array of test ids: what stands before the files' common folder once, the rest in braces."""
    i = _c(ids)
    folder = common_dir(F.transform(i, lambda x: F.substring_index(x, "::", 1)))
    head = F.concat(folder, F.lit("/"))
    rest = F.transform(i, lambda x: F.substr(x, F.length(head) + 1))
    short = F.concat(F.lit("pytest "), head, F.lit("{"), F.array_join(rest, ","), F.lit("}"))
    return F.when((F.size(i) < 2) | (folder == ""), F.concat(F.lit("pytest "), F.array_join(i, " "))).otherwise(short)


def nearest_folder(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """path, folder: the deepest of ``folders`` (folder) above each missing path, null if only the root is.

    A path has as many candidates as it has parts, so the join is on equality."""
    p = paths.select("path").distinct()
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    near = p.filter(F.size(parts) > 1).select("path", F.explode(up).alias("folder")).join(folders.select("folder").distinct(), "folder", "left_semi")
    best = near.filter("folder not in ('', '.')").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return p.join(best, "path", "left")
