"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on the distinct vectors of a bounded sample (about ``sample_rows``, chosen by a hash of the id):
each node splits its points by a random direction between two of them at the median.  Every row is
then indexed: it goes to one leaf of each tree.  A query walks all trees with one shared priority
queue, keyed by the sum of squared margins on the way, and opens leaves in that order until they hold
``effort * n ** power`` distinct vectors of all ``n`` (a vector counts in each tree that offers it), so that a
query's share of the rows falls as the table grows.  Candidates are reranked by exact Euclidean distance in
double precision.

Leaves are cut into pieces of about ``piece`` rows, so that a leaf with very many rows (equal vectors
always share their leaves) is spread over tasks; a piece returns its own nearest ``k`` for each query,
and these merge to the exact nearest of all opened leaves.  The index keeps one row a vector, with its leaf
of each tree; vectors are copied to their leaves only in the shuffle that meets the queries.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, neither as queries nor as candidates; ties go to the smaller id; a query has
all candidates if they are fewer than ``k``; rows with equal ids are candidates of their own, also of each other, and
each is a query if its id makes it one; a row without id takes no part; an empty table gives an empty result;
further columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


@dataclass
class Tree:
    normals: np.ndarray  # a row for each inner node
    offsets: np.ndarray
    children: np.ndarray  # two for each inner node; a leaf is -1 - its number
    leaves: int


def grow(points: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normals, offsets, children, leaves = [], [], [], 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(5):
                a, b = points[rng.choice(rows, 2, replace=False)]
                normal = a - b
                norm = np.linalg.norm(normal)
                if norm == 0:
                    continue
                normal = normal / norm
                along = points[rows] @ normal
                cut = float(np.median(along))
                left = along < cut
                if 0 < left.sum() < len(rows):
                    me = len(normals)
                    normals.append(normal)
                    offsets.append(cut)
                    children.append([0, 0])
                    children[me] = [node(rows[left]), node(rows[~left])]
                    return me
        leaves += 1
        return -leaves

    root = node(np.arange(len(points)))
    if root < 0:
        dim = points.shape[1] if points.ndim == 2 else 0
        return Tree(np.zeros((0, dim)), np.zeros(0), np.zeros((0, 2), np.int64), leaves)
    return Tree(np.array(normals), np.array(offsets), np.array(children, np.int64), leaves)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf number of each row."""
    at = np.zeros(len(x), np.int64) if len(tree.normals) else np.full(len(x), -1, np.int64)
    live = np.flatnonzero(at >= 0)
    while len(live):
        k = at[live]
        right = np.einsum("ij,ij->i", x[live], tree.normals[k]) >= tree.offsets[k]
        at[live] = tree.children[k, right.astype(np.int64)]
        live = live[at[live] >= 0]
    return -1 - at


def open_leaves(forest: list[Tree], distinct: list[np.ndarray], q: np.ndarray, search: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, until the leaves hold ``search`` distinct vectors."""
    along = [t.normals @ q - t.offsets for t in forest]
    queue = [(0.0, i, 0 if len(t.normals) else -1) for i, t in enumerate(forest)]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < search:
        far, i, at = heapq.heappop(queue)
        while at >= 0:
            side = along[i][at]
            near, other = (1, 0) if side >= 0 else (0, 1)
            heapq.heappush(queue, (far + float(side) ** 2, i, int(forest[i].children[at, other])))
            at = int(forest[i].children[at, near])
        out.append((i, -1 - at))
        held += int(distinct[i][-1 - at])
    return out


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v of the rows that take part; float components stay float, which halves what is shuffled."""
    floats = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    v = F.col(vec_col) if floats else F.col(vec_col).cast("array<double>")
    ok = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0.0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)


def _matrix(column: pa.Array, rows: int, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, dim)


def _assign(forest: list[Tree], dim: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = _matrix(b.column(2), n, dim)
            leaves = np.stack([leaf_of(t, x) for t in forest], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(forest)), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], ["row", "vec_id", "v", "leaves"])

    return go


def _probe(forest: list[Tree], distinct: list[np.ndarray], pieces: list[np.ndarray], dim: int, search: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(2), b.num_rows, dim)
            rows = [
                (t, leaf, p, k) for k in range(len(x)) for t, leaf in open_leaves(forest, distinct, x[k], search) for p in range(int(pieces[t][leaf]))
            ]
            t, leaf, p, k = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
            at = pa.array(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(p), *(b.column(i).take(at) for i in range(3))],
                ["tree", "leaf", "piece", "query_row", "query_id", "q"],
            )

    return go


def _nearest(k: int):
    def go(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            rows, ids = left["row"].to_numpy(np.int64), left["vec_id"].to_numpy(np.int64)
            x = np.stack(left["v"].to_numpy()).astype(np.float64)
            for own, query, q in zip(right["query_row"], right["query_id"], right["q"]):
                d = x - np.asarray(q, np.float64)
                score = np.sqrt((d * d).sum(1))
                order = np.lexsort((rows, ids, score))
                order = order[rows[order] != own][:k]
                out += [(own, query, int(rows[i]), int(ids[i]), float(score[i])) for i in order]
        return pd.DataFrame(out, columns=["query_row", "query_id", "row", "vec_id", "score"])

    return go


def nearest(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    trees: int = 12,
    leaf: int = 128,
    effort: float = 14.0,
    power: float = 0.7,
    sample_rows: int = 20_000,
    piece: int = 1024,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    ok = valid_vectors(vectors, id_col, vec_col)
    common = ok.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    search = int(np.ceil(effort * common["n"] ** power))
    ok = ok.filter(F.size("v") == dim).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    ok = scratch.table(ok, "forest-vectors")
    scale = 1 << 40
    drawn = min(scale, sample_rows * scale // common["n"])
    sample = ok.filter(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(scale)) < drawn).select("v").collect()
    points = np.unique(np.array([r["v"] for r in sample], np.float64).reshape(-1, dim), axis=0)
    rng = np.random.default_rng(seed)
    forest = [grow(points, leaf, rng) for _ in range(trees)]
    vector = ok.schema["v"].dataType.simpleString()
    index = scratch.table(ok.mapInArrow(_assign(forest, dim), f"row long, vec_id long, v {vector}, leaves array<int>"), "forest-index")
    # Rows and distinct vectors of each leaf; the number of leaves is bounded by the sample.
    places = index.select(F.posexplode("leaves").alias("tree", "leaf"), F.xxhash64("v").alias("h"))
    per_leaf = places.groupBy("tree", "leaf", "h").agg(F.count("*").alias("n")).groupBy("tree", "leaf").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()
    distinct = [np.zeros(t.leaves, np.int64) for t in forest]
    pieces = [np.ones(t.leaves, np.int64) for t in forest]
    for r in per_leaf:
        distinct[r["tree"]][r["leaf"]] = r["d"]
        pieces[r["tree"]][r["leaf"]] = -(-r["n"] // piece)
    flat = spark.createDataFrame([(i, j, int(n)) for i, p in enumerate(pieces) for j, n in enumerate(p)], "tree int, leaf int, pieces long")
    rows = index.select("row", "vec_id", "v", F.posexplode("leaves").alias("tree", "leaf"))
    cut = rows.join(F.broadcast(flat), ["tree", "leaf"])  # a row for each leaf
    cut = cut.withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces"))).select("tree", "leaf", "piece", "row", "vec_id", "v")
    queries = ok.filter(F.col("vec_id") % every == 0)
    probes = queries.mapInArrow(_probe(forest, distinct, pieces, dim, search), f"tree int, leaf int, piece long, query_row long, query_id long, q {vector}")
    key = ("tree", "leaf", "piece")
    found = cut.groupBy(*key).cogroup(probes.groupBy(*key)).applyInPandas(_nearest(k), "query_row long, query_id long, row long, vec_id long, score double")
    best = found.groupBy("query_row", "query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    best = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return scratch.result(best.select("query_id", "rank", "vec_id", "score"), "forest-result")
