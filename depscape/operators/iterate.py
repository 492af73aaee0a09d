"""State of iterative operators: each step's result is written to the shared folder and read again.

That cuts lineage and survives the loss of executors.  The folder is ``spark.checkpoint.dir`` of the
session; a temporary one is set only where the session has none and is one process, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="depscape-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Steps:
    """Tables of an iteration; ``keep`` writes one, ``release`` deletes those that aren't needed any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = self.unions = 0
        self.live: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.live[id(out)] = path
        return out

    def union(self, table: DataFrame, more: DataFrame) -> DataFrame:
        """A kept table and the rows of another: earlier rows aren't written again, except all as one table every
        eighth time, so that plans stay short."""
        self.unions += 1
        both = table.unionByName(more)
        return both if self.unions % 8 else self.keep(both)

    def release(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = self.live.pop(id(t), None) if t is not None else None
            if path:
                delete(self.spark, path)


def dense_number(steps: Steps, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds 0, 1, ... in the order of columns: numbers within range partitions plus the sizes of those before.

    The partitions are written before they are counted, and the numbers before they are used, as neither the ranges
    nor the order of equal rows need be the same when evaluated again."""
    parts = steps.keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(before)]
        before += sizes[p]
    base = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0)
    w = Window.partitionBy("_part").orderBy(*order)
    out = steps.keep(parts.withColumn(name, (base + F.row_number().over(w) - 1).cast("long")).drop("_part"))
    steps.release(parts)
    return out


def numbered_within(steps: Steps, df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds 1, 2, ... within each group, in the order of columns; a group may be most of the table."""
    out = dense_number(steps, df, [group, *order], "_dense")
    first = out.groupBy(F.col(group).alias("_group")).agg(F.min("_dense").alias("_first"))
    out = out.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn(name, (F.col("_dense") - F.col("_first") + 1).cast("int")).drop("_dense", "_group", "_first")


def partitions(df: DataFrame, rows: int) -> int:
    """Tasks for a shuffle of a kept table: the session's number, or more where one would get over ``rows``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()
