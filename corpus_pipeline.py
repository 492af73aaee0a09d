"""A training corpus from raw documents: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Between stages the result is written as Parquet in the shared scratch folder and read
again.  Decisions that need all documents find their rows by a number that each has within the stage, the others
are taken in passing: rows without an id, or with the same one, are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscape.llm import bottomk, fm_decontam, orc_tokens, pivotal_mix, zstd_langid
from depscape.llm.common import Scratch
from depscape.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with a row number, written so that it stays, and the same with the number as their id."""
    rows = scratch.table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "numbered")
    return rows, rows.withColumn("doc_id", F.col("_row")).drop("_row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letters, or no language fits clearly better than the next."""
    return zstd_langid.accepted(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; repeated rows go."""
    scratch = Scratch(spark)
    rows, by_row = _numbered(scratch, docs)
    groups = bottomk.near_duplicates(by_row).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = rows.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    kept = scratch.table(kept.select("first._row"), "kept")
    # One plan at every size, here and in the mix: texts meet decisions by shuffle.
    return rows.join(kept.hint("merge"), "_row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return fm_decontam.uncontaminated(docs.select(*COLUMNS), benchmark)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    scratch = Scratch(spark)
    rows, by_row = _numbered(scratch, docs)
    copies = pivotal_mix.mix_sources(by_row).filter("copies > 0").select(F.col("doc_id").alias("_row"), "copies")
    taken = rows.join(copies.hint("merge"), "_row")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ORC token files; returns their index."""
    # A small memo: workers still hold memory of the stages before.
    return orc_tokens.token_output(docs, tokenizer_path(), encode_special_tokens=False, memo=120_000)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_output", token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
