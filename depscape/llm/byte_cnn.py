"""Quality probability from a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Each byte has a learned
embedding, learned filters slide over every chunk, their responses are max-pooled over the chunk, and
a logistic layer turns pooled responses into the chunk's logit.  The document's probability is the
logistic of the mean chunk logit.

Training (numpy, Adam, a fixed number of steps) uses at most ``sample_rows`` labelled documents outside
the held-out fold, chosen by a hash of the id, and random chunks of each.  Labels, language, source
and id are never inputs.

Defined results: null and empty text are one chunk of padding; rows with equal ids are scored apart;
without labelled rows every score is 0.5; a label other than 0 or 1 or null is ignored; contradicting labels of
an id are both samples; a score of exactly 0.5 predicts 1; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_and_text, slices

CHUNK, STEP, DIM, WIDTH, STRIDE, FILTERS = 384, 320, 4, 8, 2, 32
_PAD = 256


@dataclass
class Network:
    embed: np.ndarray  # 257 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray  # FILTERS
    out_bias: float


def chunks_of(raw: bytes) -> np.ndarray:
    """Rows of CHUNK byte numbers, each STEP after the last, padded at the end."""
    n = max(1, -(-(len(raw) - (CHUNK - STEP)) // STEP))
    a = np.full((n - 1) * STEP + CHUNK, _PAD, np.int16)
    a[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(a, CHUNK)[::STEP]


def _windows(chunks: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """chunks x places x (WIDTH * DIM)"""
    e = embed[chunks].reshape(len(chunks), CHUNK * DIM)
    return np.lib.stride_tricks.sliding_window_view(e, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]


def pooled(chunks: np.ndarray, net: Network) -> np.ndarray:
    x = _windows(chunks, net.embed)
    n, places, width = x.shape
    y = np.ascontiguousarray(x).reshape(n * places, width) @ net.filters
    return np.maximum(y.reshape(n, places, FILTERS).max(1) + net.bias, 0)


def train(texts: list[bytes], labels: list[int], steps: int = 260, batch: int = 48, per_text: int = 4, rate: float = 0.01, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (257, DIM)).astype("f4"), rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype("f4"),
        np.zeros(FILTERS, "f4"), np.zeros(FILTERS, "f4"), 0.0,
    )
    net.embed[_PAD] = 0
    if not texts:
        return net
    net.out = rng.normal(0, 0.1, FILTERS).astype("f4")
    y_all = np.array(labels, "f4")
    pools = [np.flatnonzero(y_all == k) for k in (0, 1)]
    pools = [p for p in pools if len(p)]
    share = float(y_all.mean())
    names = ("embed", "filters", "bias", "out", "out_bias")
    m = {k: 0.0 for k in names}
    v = {k: 0.0 for k in names}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, batch // len(pools)) for p in pools])
        chunks, owner = [], []
        for i, k in enumerate(pick.tolist()):
            own = chunks_of(texts[k])
            chunks.append(own[rng.integers(0, len(own), per_text)])
            owner += [i] * per_text
        c, owner = np.concatenate(chunks), np.array(owner)
        x = np.ascontiguousarray(_windows(c, net.embed))
        n, places, width = x.shape
        pre = (x.reshape(n * places, width) @ net.filters).reshape(n, places, FILTERS)
        best = pre.argmax(1)
        top = np.take_along_axis(pre, best[:, None, :], 1)[:, 0] + net.bias
        h = np.maximum(top, 0)
        logit = np.bincount(owner, h @ net.out + net.out_bias, len(pick)) / per_text
        prob = 1 / (1 + np.exp(-logit))
        g_logit = (np.repeat((prob - y_all[pick]) / len(pick), per_text) / per_text).astype("f4")
        g_h = np.outer(g_logit, net.out) * (top > 0)
        won = x[np.arange(n)[:, None], best]  # n x FILTERS x width
        g_x = g_h[:, :, None] * net.filters.T[None]
        places_of = (best[:, :, None] * STRIDE + np.arange(WIDTH)).clip(0, CHUNK - 1)
        g_embed = np.zeros((257, DIM), "f4")
        np.add.at(g_embed, c[np.arange(n)[:, None, None], places_of], g_x.reshape(n, FILTERS, WIDTH, DIM))
        g_embed[_PAD] = 0
        grads = {
            "embed": g_embed, "filters": np.einsum("nf,nfw->wf", g_h, won), "bias": g_h.sum(0), "out": h.T @ g_logit + 1e-4 * net.out,
            "out_bias": float(g_logit.sum()),
        }
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * np.square(grads[k])
            delta = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            setattr(net, k, getattr(net, k) - delta)
    if len(pools) == 2:  # batches were balanced; go back to the sample's odds
        net.out_bias += 0.5 * float(np.log(share / (1 - share)))
    for k in ("embed", "filters", "bias", "out"):
        setattr(net, k, np.asarray(getattr(net, k), "f4"))
    return net


def _scorer(net: Network):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, rows=256, nbytes=1 << 19):
            total, n = np.zeros(len(ids)), np.zeros(len(ids))
            parts, owner = [], []

            def flush():
                if parts:
                    logit = pooled(np.concatenate(parts), net) @ net.out + net.out_bias
                    np.add.at(total, np.array(owner), logit)
                    np.add.at(n, np.array(owner), 1)
                    parts.clear()
                    owner.clear()

            for i, t in enumerate(texts):
                own = chunks_of(t or b"")
                for at in range(0, len(own), 128):
                    parts.append(own[at : at + 128])
                    owner += [i] * len(parts[-1])
                    if len(owner) >= 128:
                        flush()
            flush()
            score = 1 / (1 + np.exp(-total / n))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score)], ["doc_id", "score"])

    return go


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, max_bytes: int = 1 << 16) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most ``rows`` labelled documents outside the held-out fold; of a text over
    ``max_bytes`` the training chunks come from a window of that size, at a place by hash anywhere in it."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", folds, fold))
        .orderBy(F.xxhash64(F.lit("cnn"), "doc_id"), "doc_id", "y")
        .limit(rows)
    )
    few = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, y int")
    text = F.coalesce(F.col("text"), F.lit("").cast("binary"))
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.lit(1), F.octet_length(text) - max_bytes + 1)).cast("int")
    got = id_and_text(docs).join(F.broadcast(few), "doc_id").select("doc_id", "y", F.substr(text, place + 1, F.lit(max_bytes)).alias("text"))
    # few has at most ``rows`` rows; of texts with a repeated id, those first by hash are taken.
    got = got.orderBy(F.xxhash64(F.lit("cnn"), "doc_id", "text"), "doc_id", "text", "y").limit(2 * rows)
    found = sorted(((r["doc_id"], r["y"], bytes(r["text"])) for r in got.collect()))
    return [t for _, _, t in found], [y for _, y, _ in found]


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample_rows: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    texts, y = labelled_sample(docs, labels, "quality", folds, fold, sample_rows)
    net = train(texts, y)
    scored = id_and_text(docs).mapInArrow(_scorer(net), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
