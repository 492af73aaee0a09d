"""How far every symbol reaches, and which symbols stand for a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DEPENDENCY_KINDS
from .iterate import Steps, dense_number, is_empty, numbered_within, partitions
from .traverse import of_kinds

# Targets of one block of numbers share a row of a node's set, so rows stay short; edges whose sets one task joins.
_BLOCK, _EDGES = 1 << 18, 100_000


def reach_counts(links: DataFrame, targets: DataFrame, depths: tuple[int, ...] = (3, 10), whole: bool = True, kinds: tuple[str, ...] | None = DEPENDENCY_KINDS) -> DataFrame:
    """target, d<n> for each depth, and ``whole``: how many nodes depend on a target within each depth, and at all.

    Without ``whole`` the search stops at the largest depth, which bounds it on graphs with cycles; targets that nothing
    depends on have zeros.

    Pairs of a target and a node that reaches it are never shuffled or written one by one.  Each node that something
    depends on gets the targets it reaches as arrays of numbers, level by level.  A node that nothing depends on passes
    nothing on: the arrays of what it depends on meet in one task, which counts them by target and depth."""
    steps = Steps(links.sparkSession, "reach")
    wanted = targets.select("target").distinct()
    most = None if whole else max(depths)
    e = of_kinds(links, kinds).select("src", "dst").filter("src is not null and dst is not null")
    nodes = e.select("dst").distinct().join(wanted.select(F.col("target").alias("dst"), F.lit(True).alias("wanted")), "dst", "left")
    nodes = dense_number(steps, nodes, ["dst"], "v")
    n = nodes.count()
    number = lambda top: "int" if top < 1 << 31 else "long"
    nodes = nodes.withColumn("v", F.col("v").cast(number(n)))
    e = steps.keep(e.join(nodes.select(F.col("dst").alias("src"), F.col("v").alias("s")), "src", "left"))  # s: null where nothing depends on src
    inner = steps.keep(e.filter("s is not null").join(nodes.select("dst", "v"), "dst").select("s", "v").distinct())

    tasks = partitions(inner, _EDGES)
    block = F.floor(F.col("v") / _BLOCK).cast("int")
    levels = [steps.keep(nodes.filter("wanted").select("v", block.alias("b"), F.array("v").alias("ts"), F.lit(0).alias("depth")))]
    while most is None or len(levels) <= most:
        depth = len(levels)
        step = inner.join(levels[-1], "v").select(F.col("s").alias("v"), "b", "ts", F.lit(depth).alias("depth"))
        met = _all(levels).unionByName(step).repartition(tasks, "v", "b").select("v", "b", "depth", F.explode("ts").alias("t"))
        new = met.groupBy("v", "b", "t").agg(F.min("depth").alias("depth")).filter(F.col("depth") == depth)
        front = steps.keep(new.groupBy("v", "b").agg(F.sort_array(F.collect_list("t")).alias("ts")).withColumn("depth", F.lit(depth)))
        if is_empty(front):
            break
        levels.append(front)
    sets = _all(levels)
    counts = sets.filter("depth > 0").select(F.explode("ts").alias("t"), "depth").groupBy("t", "depth").agg(F.count("*").alias("n"))

    # A code is a depth and a number.
    code = F.transform("ts", lambda t: (F.col("depth").cast("long") * n + t).cast(number(n * len(levels))))
    codes = sets.select("v", "b", code.alias("cs")).groupBy("v", "b").agg(F.flatten(F.collect_list("cs")).alias("cs"))
    codes = codes.join(nodes.select("v", "dst"), "v").select("dst", "cs")
    outer = e.filter("s is null").select("src", "dst")
    met = outer.join(codes, "dst").select("src", "cs").repartition(partitions(outer, _EDGES), "src").select("src", F.explode("cs").alias("c"))
    met = met.select("src", (F.col("c") % n).alias("t"), (F.floor(F.col("c") / n) + 1).cast("int").alias("depth"))
    if most is not None:
        met = met.filter(F.col("depth") <= most)
    met = met.groupBy("src", "t").agg(F.min("depth").alias("depth")).groupBy("t", "depth").agg(F.count("*").alias("n"))

    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    aggs = [total(F.col("depth") <= k).alias(f"d{k}") for k in depths] + ([total(F.lit(True)).alias("whole")] if whole else [])
    names = [f"d{k}" for k in depths] + (["whole"] if whole else [])
    per = counts.unionByName(met).groupBy("t").agg(*aggs).join(nodes.select(F.col("v").alias("t"), F.col("dst").alias("target")), "t")
    return wanted.join(per, "target", "left").select("target", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in names])


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def ranked_targets(reach: DataFrame, measure: str = "d10") -> DataFrame:
    """role, target, reach: of the targets that anything depends on, by reach and then id, the last (hub), the one at
    99 % (p99) and the middle one (median); shares round half up.  Numbers come from written range partitions, not
    from one sorted task."""
    steps = Steps(reach.sparkSession, "targets")
    some = dense_number(steps, reach.filter(F.col(measure) > 0).select("target", F.col(measure).alias("reach")), ["reach", "target"], "n")
    last = some.agg((F.count("*") - 1).alias("last"))  # one row
    at = lambda share: F.floor(F.col("last") * F.lit(share) + F.lit(0.5)).cast("long")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), at(s).alias("n")) for r, s in (("hub", 1.0), ("p99", 0.99), ("median", 0.5))])
    want = last.select(F.explode(roles).alias("w")).select("w.role", "w.n")
    return some.join(F.broadcast(want), "n").select("role", "target", "reach")  # want: three rows


def blast_order(reached: DataFrame) -> DataFrame:
    """Adds rank: the place of a reached node in its target's raw list, by depth and then id."""
    return numbered_within(Steps(reached.sparkSession, "order"), reached, "target", ["depth", "id"], "rank")
