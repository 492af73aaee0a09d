"""Language ID by compression: the language whose dictionary compresses a text best.

For each language a raw-content zstandard dictionary holds sample texts.  A text is lower-cased
and compressed in blocks with every dictionary; the language with the smallest total wins.  Its score
is the margin 1 - smallest / second smallest.  Texts whose margin is under ``min_margin`` are rejected
(column ``rejected``); they still carry the best guess.

The dictionaries come from a bounded sample of labelled rows: about ``sample_rows`` a language, chosen
by a hash of the id, each giving a window of ``row_bytes`` code points,
at a place by hash anywhere in its text, to a dictionary of at most ``dict_bytes``.

Defined results: null text, or text without a letter, or no labelled rows at all: ``und``, score 0,
rejected.  Equal sizes go to the smaller language code, with score 0.  With a single language the
second size is that without any dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_and_text, rows_that_stay, slices

_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; fractions, superscripts and other numbers aren't."""
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def fit_dictionaries(train: DataFrame, sample_rows: int = 300, dict_bytes: int = 64 << 10, row_bytes: int = 6000) -> dict[str, bytes]:
    """lang -> dictionary, from rows (doc_id, text, lang)."""
    rows = train.filter(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return {}
    scale = 1 << 40
    wanted = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(scale, sample_rows * scale // n))])
    h = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(scale))
    place = F.pmod(F.xxhash64(F.lit("place"), F.col("doc_id")), F.greatest(F.lit(1), F.length("text") - row_bytes + 1)).cast("int")
    chosen = rows.filter(F.col("text").isNotNull() & (h < F.element_at(wanted, F.col("lang")))).select(
        "lang", h.alias("h"), F.substr("text", place + 1, F.lit(row_bytes)).alias("text")
    )
    # At most about sample_rows rows a language reach the driver.
    out: dict[str, bytearray] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        held = out.setdefault(r["lang"], bytearray())
        if len(held) < dict_bytes:
            held += r["text"].lower().encode()[: dict_bytes - len(held)] + b"\n"
    return {lang: bytes(d) for lang, d in sorted(out.items())}


def predictor(dictionaries: dict[str, bytes], level: int = 5, block: int = 8 << 10, min_margin: float = 0.005):
    """A function from texts (bytes) to language, score and whether the text is rejected, of each."""
    import zstandard as z

    langs = sorted(dictionaries)
    coders = []
    for lang in langs:
        d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        coders.append(z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False).compress)
    if len(coders) == 1:
        coders.append(z.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress)

    def one(t: bytes | None) -> tuple[str, float, bool]:
        s = t.decode() if t else ""
        if not langs or not has_letter(s):
            return "und", 0.0, True
        raw = s.lower().encode()
        sizes = [0] * len(coders)
        for at in range(0, len(raw), block):
            part = raw[at : at + block]
            for k, c in enumerate(coders):
                sizes[k] += len(c(part))
        if len(langs) == 1:
            best, first, second = 0, sizes[0], max(sizes)
        else:
            best = min(range(len(sizes)), key=sizes.__getitem__)
            first, second = sorted(sizes)[:2]
        margin = 1.0 - first / second
        return langs[best], margin, margin < min_margin

    return one


def _classifier(dictionaries: dict[str, bytes], options: dict):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = predictor(dictionaries, **options)
        for ids, texts in slices(batches):
            pred, score, out = zip(*map(one, texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return go


def classify(docs: DataFrame, dictionaries: dict[str, bytes], **options) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of ``docs``; options as of ``predictor``."""
    return id_and_text(docs).mapInArrow(_classifier(dictionaries, options), "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, that aren't rejected; learns as ``detect`` does."""
    dictionaries = fit_dictionaries(docs.filter(~held_out("doc_id", folds, fold)))

    def goes():
        one = predictor(dictionaries, **options)
        return lambda texts: [one(t)[2] for t in texts]

    return rows_that_stay(docs, goes)


def detect(docs: DataFrame, folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from rows outside the held-out fold."""
    dictionaries = fit_dictionaries(docs.filter(~held_out("doc_id", folds, fold)))
    return classify(docs, dictionaries, **options).select(
        "doc_id", held_out("doc_id", folds, fold).alias("held_out"), "lang_pred", "score", "rejected"
    )
