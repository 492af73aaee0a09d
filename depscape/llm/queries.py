"""The contract queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, byte_cnn, credential_links, fm_decontam, lm_automaton, orc_tokens, pii_crf, pivotal_mix, rp_forest, zstd_langid

#: The vocabulary file of the token output.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_documents, _benchmark, _labels, _embeddings = (_table(n) for n in ("documents", "benchmark", "labels", "embeddings"))


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_pii(_documents(spark, sf_dir))


def op2_lm_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_automaton.score_documents(_documents(spark, sf_dir))


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.score_quality(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_links.scan_secrets(_documents(spark, sf_dir))


def op5_bottomk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(_documents(spark, sf_dir), shingle=2)


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.token_output(_documents(spark, sf_dir), tokenizer_path(), end_id=2, encode_special_tokens=False)


def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(_embeddings(spark, sf_dir))


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def contamination_digest(found: DataFrame) -> DataFrame:
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(fm_decontam.find_contamination(_documents(spark, sf_dir), _benchmark(spark, sf_dir)))


def op10_zstd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_langid.detect(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_crf, op2_lm_automaton, op3_byte_cnn, op4_credential_links, op5_bottomk_dedup, op6_orc_tokens, op7_rp_forest,
        op8_pivotal_mix, op9_fm_decontam, op10_zstd_langid, pipeline,
    )
}

#: Windows of the items, found in documents by equality of ten (or all) consecutive words.
_WORDS = r"list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE_SQL: dict[str, str] = {
    "op9_fm_decontam": f"""
with d as (select row_number() over () as rid, doc_id, coalesce({_WORDS.format(t="text")}, []) as w from documents),
b as (select item_id, {_WORDS.format(t="text")} as w from benchmark where text is not null),
win as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from win),
grams as (
  select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as g
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
occ as (select rid, i, n, item_id from grams join win using (n, g)),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from occ) group by rid),
found as (
  select rid, count(*) as n_items, string_agg(x, ',' order by x) as s
  from (select distinct rid, item_id::varchar as x from occ) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join found using (rid)""",
}
