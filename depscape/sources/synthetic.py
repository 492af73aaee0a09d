"""A layered random dependency graph, the same for a seed on every machine.

Files hold ``per_file`` symbols and modules ``per_module`` files.  Most edges stay in a file or module,
some go to hub symbols, so that fan-in is skewed.  Every row follows from hashes of its own number, so
the graph is generated in parallel at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def synthetic_graph(spark: SparkSession, nodes: int, per_file: int = 10, per_module: int = 50, edges_per_node: int = 5, seed: int = 7) -> DataFrame:
    """src, dst, kind, prov: edges from later to earlier layers, and a few back."""
    span = per_file * per_module
    e = spark.range(nodes * edges_per_node).select((F.col("id") / edges_per_node).cast("long").alias("src"), F.col("id").alias("k"))
    u, v, w = (_draw(F.lit(seed), F.lit(i), "k") for i in range(3))
    local = F.floor(F.col("src") / per_file) * per_file + F.floor(v * per_file)
    module = F.floor(F.col("src") / span) * span + F.floor(v * span)
    hub = F.floor(F.pow(v, F.lit(4.0)) * nodes)
    earlier = F.floor(v * F.greatest(F.col("src"), F.lit(1)))
    dst = F.when(u < 0.45, local).when(u < 0.75, module).when(u < 0.9, earlier).otherwise(hub)
    kind = F.when(w < 0.7, F.lit("calls")).when(w < 0.85, F.lit("imports")).when(w < 0.95, F.lit("inherits")).otherwise(F.lit("contains"))
    prov = F.when(_draw(F.lit(seed), F.lit(9), "k") < 0.8, F.lit("extracted")).otherwise(F.lit("inferred"))
    out = e.select("src", F.least(dst, F.lit(nodes - 1)).cast("long").alias("dst"), kind.alias("kind"), prov.alias("prov"))
    return out.filter("src <> dst").distinct()
