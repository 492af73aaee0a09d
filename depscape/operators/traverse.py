"""Reverse traversals of the link graph: who depends on whom, how deep, how certainly.

A link (src, dst, kind, prov) means src depends on dst.  Traversals run level by level for many
targets at once: a level is one join of the frontier with the links on ``dst``, and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DEPENDENCY_KINDS, EDGE_KINDS, confidence, from_ordinal, ordinal, trusted
from .iterate import Steps, is_empty


_BROADCAST_ROWS = 100_000


def of_kinds(links: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    return links if kinds is None else links.filter(F.col("kind").isin(*kinds))


def trusted_links(links: DataFrame) -> DataFrame:
    return links.filter(trusted(F.col("prov")))


def blast_radius(links: DataFrame, targets: DataFrame, max_depth: int | None = 3, kinds: tuple[str, ...] | None = DEPENDENCY_KINDS) -> DataFrame:
    """target, id, depth: everything that reaches each target (column ``target``), at its least depth; the
    target itself is left out.  ``max_depth`` None: to the end."""
    steps = Steps(links.sparkSession, "blast")
    edges = steps.keep(of_kinds(links, kinds).select("src", "dst").distinct())
    seen = steps.keep(targets.select("target").distinct().select("target", F.col("target").alias("id"), F.lit(0).alias("depth")))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = front.join(edges, front["id"] == edges["dst"]).select("target", F.col("src").alias("id")).distinct()
        front = steps.keep(reached.join(seen, ["target", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if is_empty(front):
            break
        seen = steps.union(seen, front)
    return seen.filter("depth > 0")


def blast_radius_sql(spark: SparkSession, links: DataFrame, targets: DataFrame, max_depth: int = 3, kinds: tuple[str, ...] | None = DEPENDENCY_KINDS) -> DataFrame:
    """The same as one query, a common table expression a level.  A recursive one may only append (UNION ALL): its rows are
    the walks, which outnumber the nodes and which Spark limits; here each level holds a node once a target."""
    edges = of_kinds(links, kinds).select("src", "dst").distinct()
    levels = ["l0 AS (SELECT target, target AS id FROM {targets})"]
    for n in range(1, max_depth + 1):
        levels.append(f"l{n} AS (SELECT DISTINCT l.target, e.src AS id FROM l{n - 1} l JOIN {{edges}} e ON e.dst = l.id)")
    every = " UNION ALL ".join(f"SELECT target, id, {n} AS depth FROM l{n}" for n in range(max_depth + 1))
    return spark.sql(
        f"WITH {', '.join(levels)} SELECT target, id, min(depth) AS depth FROM ({every}) GROUP BY target, id HAVING id <> target", edges=edges, targets=targets.select("target").distinct()
    )


def dependents(links: DataFrame, roots: DataFrame, max_depth: int = 3, kinds: tuple[str, ...] = DEPENDENCY_KINDS) -> tuple[DataFrame, DataFrame]:
    """Dependents of each query's roots, and what lies beyond.

    ``roots``: (query, id), one or more roots a query.  The first result has query, id, depth, via, kind,
    edge_conf, path_conf: each dependent at its least depth, through the path whose weakest edge is
    strongest, then the stronger edge, the smaller ``via`` and the earlier kind.  The second has query,
    beyond: nodes at the depth limit that still have an unseen dependent.
    """
    steps = Steps(links.sparkSession, "dependents")
    # Links of the same ends and kind stay apart: the least way is that of the most certain of them.
    edges = of_kinds(links, kinds).select("dst", "src", ordinal(F.col("kind"), EDGE_KINDS).alias("kind"), confidence(F.col("prov")).alias("edge_conf"))
    columns = "query, id, depth, via, kind, edge_conf, path_conf".split(", ")
    null = F.lit(None)
    seen = roots.select("query", "id").distinct().select(
        "query", "id", F.lit(0).alias("depth"), null.cast("string").alias("via"), null.cast("int").alias("kind"), null.cast("int").alias("edge_conf"),
        F.lit(0).alias("path_conf"),
    )
    seen = steps.keep(seen)
    front = seen
    n = known = seen.count()
    for depth in range(1, max_depth + 1):
        f = front.select("query", F.col("id").alias("dst"), F.col("path_conf").alias("base"))
        step = edges.join(_small(f, n), "dst").join(_small(seen.select("query", F.col("id").alias("src")), known), ["query", "src"], "left_anti")
        way = F.struct(F.greatest("base", "edge_conf").alias("path_conf"), F.col("edge_conf"), F.col("dst").alias("via"), F.col("kind"))
        best = step.groupBy("query", F.col("src").alias("id")).agg(F.min(way).alias("w"))
        front = steps.keep(best.select("query", "id", F.lit(depth).alias("depth"), "w.via", "w.kind", "w.edge_conf", "w.path_conf").select(*columns))
        n = front.count()
        if not n:
            break
        known += n
        seen = steps.union(seen, front)
    last = front.select("query", F.col("id").alias("dst"))
    more = last.join(edges.select("dst", "src"), "dst").join(seen.select("query", F.col("id").alias("src")), ["query", "src"], "left_anti")
    more = more.select("query", "dst").distinct().groupBy("query").agg(F.count("*").alias("beyond"))
    queries = roots.select("query").distinct()
    beyond = queries.join(more, "query", "left").select("query", F.coalesce("beyond", F.lit(0)).alias("beyond"))
    reached = seen.filter("depth > 0").withColumn("kind", from_ordinal(F.col("kind"), EDGE_KINDS))
    return reached, beyond


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A few nodes meet links where these are, and the links needn't be shuffled."""
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else df


def covering_tests(links: DataFrame, symbols: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """target, id, depth: test symbols that reach a target through calls and references; the target itself,
    at depth 0, if it is a test."""
    tests = symbols.filter("is_test").select("id")
    reach = blast_radius(links, targets, depth, ("calls", "references"))
    own = targets.select("target").distinct().select("target", F.col("target").alias("id"), F.lit(0).alias("depth"))
    return own.unionByName(reach).join(tests, "id", "left_semi").select("target", "id", "depth")


def inheritance(links: DataFrame, classes: DataFrame, up: bool, max_depth: int = 6) -> DataFrame:
    """cls, id, depth: base classes (up) or subclasses of each class (column ``cls``), itself left out."""
    e = links.filter("kind = 'inherits'")
    turned = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "prov") if up else e
    return blast_radius(turned, classes.select(F.col("cls").alias("target")), max_depth, ("inherits",)).withColumnRenamed("target", "cls")


def overrides(links: DataFrame, symbols: DataFrame, methods: DataFrame, max_depth: int = 6) -> DataFrame:
    """id, relation (overrides, overridden_by), other, path, start_line: methods of the same name in base and
    subclasses of each method's class (``methods``: id)."""
    m = symbols.join(methods.select("id"), "id", "left_semi").filter("parent is not null")
    m = m.select("id", "name", F.col("parent").alias("cls"))
    classes = m.select("cls").distinct()
    other = symbols.select(F.col("parent").alias("oc"), F.col("id").alias("other"), "name", "path", "start_line", "qualified")
    parts = []
    for up, relation in ((True, "overrides"), (False, "overridden_by")):
        near = inheritance(links, classes, up, max_depth).select("cls", F.col("id").alias("oc"))
        parts.append(m.join(near, "cls").join(other, ["oc", "name"]).select("id", F.lit(relation).alias("relation"), "other", "qualified", "path", "start_line"))
    return parts[0].unionByName(parts[1])
