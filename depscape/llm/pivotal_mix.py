r"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies (target / source size).
Its integral part is taken outright.  The fractional parts are rounded *dependently*: documents
exchange probability mass, at rates that keep their expected words constant, until one of them is
integral; the others go on to the next exchange.  Groups of bounded size do this
in parallel and leave one fractional document each; a reduction tree combines these residuals,
``fan_in`` groups at a time, until one document a source is left, which a hashed coin rounds.
So a source misses its target by less than the size of one (small) document, each document's
expected copies are exact, and nothing depends on how rows were partitioned.

Defined results: null or empty text has size 0, target share like any other and takes 0 words;
null source is a source of its own, the last; rows with equal ids are separate documents; null
ids are allowed; a source of size 0 has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_OUT = "doc_id long, source string, size long, source_size long, target double, whole long, bucket long, p double, bit int"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1)
        n = [len(t.as_buffer().to_pybytes().split()) if t.is_valid else 0 for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "source", "size"])


def document_sizes(docs: DataFrame) -> DataFrame:
    r"""doc_id, source, size: words ``[^\x20\x09-\x0D]+`` of each whole text."""
    cols = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
        F.col("source").cast("string").alias("source"),
    )
    return cols.mapInArrow(_sizes, "doc_id long, source string, size long")


def _ranked(scratch: Scratch, sources: DataFrame) -> DataFrame:
    """Adds ``k``, the rank of a source by code point (null last): ranks within range partitions plus
    the counts of the partitions before, so that no task sees all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = scratch.table(
        sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "mix-sources"
    )
    counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, offset = 0, {}
    for part in sorted(counts):
        offset[part], before = before, before + counts[part]
    from pyspark.sql import Window

    w = Window.partitionBy("_part").orderBy(*order)
    base = F.element_at(F.create_map(*[F.lit(x) for kv in offset.items() for x in kv]), F.col("_part")) if offset else F.lit(0)
    return parts.withColumn("k", base + F.row_number().over(w) - 1).drop("_part")


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, n_docs, source_size, target: ``share`` of all words by weight; a target stops at ``most``
    times its source, and what is above is shared again by weight until none is above."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = _ranked(scratch, per)
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % n + 1).cast("int"))
    table = scratch.table(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most))), "mix-weights")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    # A source is full once its share of what is left reaches its most; each pass fixes the full ones.
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        left, w = table.agg(
            F.lit(total) - F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        new = left / w if w else level
        if not w or new <= level:
            break
        level = new
    target = F.least(F.col("most"), F.col("weight") * F.lit(level))
    return table.select("source", "n_docs", "source_size", target.alias("target"))


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds p, given by descending size: (0, 1 or, at the one place returned, a fraction).  Words
    (sum of size * p) stay constant; each p keeps its expectation.  -1: no fraction is left.

    The largest open document first trades with as many of the next as it takes to make it integral in
    one step, each within its own bounds.  Where the rest can't do that, documents trade in pairs: one
    of two becomes integral, the other goes on.
    """
    p = p.copy()
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        rest = i + 1 + np.flatnonzero((p[i + 1 :] > 0.0) & (p[i + 1 :] < 1.0))
        # Shares of the trade: upwards i gets (1 - p) * size words from the others, downwards it gives p * size.
        most = np.minimum(p[rest] * size[rest] / ((1 - p[i]) * size[i]), (1 - p[rest]) * size[rest] / (p[i] * size[i]))
        reach = np.cumsum(most)
        k = int(np.searchsorted(reach, 1.0))
        if k == len(rest):
            break
        share = most[: k + 1].copy()
        share[k] -= reach[k] - 1.0
        move = -(1 - p[i]) if u[i] < p[i] else p[i]
        p[rest[: k + 1]] = _snap(p[rest[: k + 1]] + share * move * size[i] / size[rest[: k + 1]])
        p[i] = 1.0 if move < 0 else 0.0
    i = -1
    for j in np.flatnonzero((p > 0.0) & (p < 1.0)).tolist():
        if i < 0:
            i = j
            continue
        si, sj = size[i], size[j]
        up = min((1 - p[i]) * si, p[j] * sj)  # words that can go from j to i
        down = min(p[i] * si, (1 - p[j]) * sj)  # and from i to j
        move = up if u[j] * (up + down) < down else -down
        p[i], p[j] = _snap(np.array([p[i] + move / si, p[j] - move / sj]))
        i = next((k for k in (i, j) if 0.0 < p[k] < 1.0), -1)
    return p, i


def _snap(p: np.ndarray) -> np.ndarray:
    return np.where(p < 1e-12, 0.0, np.where(p > 1 - 1e-12, 1.0, p))


def _coins(ids: pd.Series, size: pd.Series, level: int) -> np.ndarray:
    from .common import mix

    x = mix(ids.fillna(-1).to_numpy(np.int64).view(np.uint64) * np.uint64(31) + size.to_numpy(np.int64).view(np.uint64))
    return (mix(x + np.uint64(level)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _rounder(level: int):
    def go(g: pd.DataFrame) -> pd.DataFrame:
        u = _coins(g["doc_id"], g["size"], level)
        order = np.lexsort((u, g["doc_id"].fillna(-1).to_numpy(np.int64), -g["size"].to_numpy(np.int64)))
        g, u = g.iloc[order].reset_index(drop=True), u[order]
        p, left = pivot(g["size"].to_numpy(float), g["p"].to_numpy(float), u)
        bit = np.rint(p).astype("int32")
        g["p"] = p
        g["bit"] = pd.array(bit, dtype="Int32")
        if left >= 0:
            g.loc[left, "bit"] = pd.NA
        return g

    return go


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    group: int = 2048,
    fan_in: int = 64,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.table(document_sizes(docs), "mix-sizes")
    targets = scratch.table(source_targets(scratch, sizes, weights, share, most), "mix-targets")
    joined = sizes.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = joined.select(
        "d.doc_id", "d.source", "d.size", "t.source_size", "t.target",
        F.floor(rate).cast("long").alias("whole"),
        F.pmod(F.xxhash64("d.doc_id", "d.size"), F.ceil(F.col("n_docs") / group)).cast("long").alias("bucket"),
        F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)).alias("p"),
        F.lit(None).cast("int").alias("bit"),
    )
    level = 0
    done: list[DataFrame] = []
    while True:
        out = scratch.table(rows.groupBy("source", "bucket").applyInPandas(_rounder(level), _OUT), f"mix-level{level}")
        done.append(out.filter(F.col("bit").isNotNull()))
        rest = out.filter(F.col("bit").isNull())
        widest = rest.agg(F.max("bucket")).first()[0]
        if not widest:
            break
        rows = rest.withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long"))
        level += 1
    coin = F.pmod(F.xxhash64("doc_id", "size", F.lit(level + 1)), F.lit(1 << 30)) / float(1 << 30)
    done.append(rest.withColumn("bit", (coin < F.col("p")).cast("int")))
    everything = done[0]
    for part in done[1:]:
        everything = everything.unionByName(part)
    copies = F.col("whole") + F.col("bit")
    out = everything.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
    return scratch.result(out, "mix-result")
