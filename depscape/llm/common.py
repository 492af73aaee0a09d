"""Shared plumbing of the training-data operators: scratch tables, words and hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one if unset and all is one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="depscape-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/depscape/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    ``drop`` removes tables that no later step reads, to bound disk use.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self._alive: list[DataFrame] = []  # so that no id is used again

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._alive.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.paths.pop(id(t), None)
            if path:
                remove(self.spark, path)

    def renamed(self, held: DataFrame, view: DataFrame) -> DataFrame:
        """A view of a held table, dropped in its place."""
        self.paths[id(view)] = self.paths.pop(id(held))
        self._alive.append(view)
        return view

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Writes an operator's result and drops every other table it has made."""
        before = list(self.paths.values())
        out = self.table(df, name)
        for path in before:
            remove(self.spark, path)
        self.paths, self._alive = {id(out): self.paths[id(out)]}, [out]
        return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to now, instead of at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads: id as long, text as UTF-8 bytes (null stays null)."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")
    )


def rows_that_stay(docs: DataFrame, goes: Callable[[], Callable[[list], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose texts (bytes; null None) a judge doesn't send away: one pass, nothing shuffled.

    ``goes`` makes the judge in each task: a list of texts -> whether each goes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = goes()
        for b in batches:
            texts = b.column(b.schema.names.index(text_col)).cast(pa.binary())
            gone: list[bool] = []
            for _, part in slices(iter([pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), texts], ["i", "t"])])):
                gone += judge(part)
            yield b.filter(pa.array([not g for g in gone], pa.bool_()))

    return docs.mapInArrow(go, docs.schema)


def held_out(id_col: str, folds: int, fold: int):
    """crc32(id as text) mod folds = fold; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds) == F.lit(fold), F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, nbytes: int = 4 << 20) -> Iterator[tuple[list, list]]:
    """(ids, texts as bytes; null text as None) of a few rows at a time, so that memory stays bounded
    by ``nbytes`` plus one text however long texts are."""
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        n, at = b.num_rows, 0
        while at < n:
            end, size = at, 0
            while end < n and end - at < rows and size < nbytes:
                t = texts[end]
                size += t.as_buffer().size if t.is_valid else 0
                end += 1
            yield ids.slice(at, end - at).to_pylist(), texts.slice(at, end - at).to_pylist()
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: uniform bits from any uint64s."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of each ordered pair of 64-bit hashes."""
    return mix(mix(a) * np.uint64(3) + b)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; a memo that is emptied when it holds ``most`` words."""

    def __init__(self, most: int = 600_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(texts: list, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    r"""Hashes of all words ``[^\x20\x09-\x0D]+`` of A-Z lower-cased texts, and the number of each text."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = t.translate(LOWER).split()
            counts[i] = len(w)
            words += w
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), counts


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(sorted_keys):
        return sorted_keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return sorted_keys[first], np.diff(np.concatenate((first, [len(sorted_keys)])))


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key in a sorted distinct array; -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)
