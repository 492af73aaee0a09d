r"""Language-model scores from a weighted backoff automaton.

Bigrams smoothed with a Dirichlet prior, p(w | h) = (c(hw) + k p(w)) / (c(h) + k) with
p(w) = (c(w) + 1) / (N + V + 1), are states and arcs: a state for each word seen in training, a
weighted arc for each seen bigram, and a failure arc of weight k / (c(h) + k) to the root, whose arcs
are the single words.  A traversal reads a text left to right: it takes the arc of the state it
carries, or else the failure arc and the root's arc, adds the weights, and carries on in the state of
the word just read (the root, if training never had it).

Counts cover all training text and grow with it, so no machine holds the automaton.  Documents are
packed into blocks of a few megabytes; each block lists its distinct words and bigrams with its own
counts, these meet by key range, and a block gets back the totals that exceed its own.  From them it
compiles just the part of the automaton that its texts can reach.  Keys are 64-bit hashes.

Defined results: null or empty text is one end token; rows with equal ids are separate documents; a
null id is never held out; with no training text every probability is that of an unseen word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, find, held_out, id_and_text, mix, pair_key, runs

_ROOT, _START, _END = 0, 1, 2  # no word has these numbers
_START_HASH, _END_HASH = xxhash.xxh3_64_intdigest(b"\n\n"), xxhash.xxh3_64_intdigest(b"\n")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20  # bytes of text that are words at a time
_BLOCK_SCHEMA = "block long, ids array<long>, held array<boolean>, sizes array<int>, texts binary"
_KEY_SCHEMA = "kind int, part long, block long, keys binary, counts binary"
_BACK_SCHEMA = "block long, kind int, keys binary, counts binary, tokens long, types long"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _squeeze(a: np.ndarray) -> bytes:
    """Fixed-width integers, bytes of equal place together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _expand(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(b.T).view(dtype).ravel()


def _squeeze_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0))) if len(keys) else b""


def _expand_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_expand(raw, np.uint64), dtype=np.uint64) if raw else np.zeros(0, np.uint64)


def _expand_counts(raw: bytes) -> np.ndarray:
    return _expand(raw, np.int64) if raw else np.zeros(0, np.int64)


def _squeeze_counts(c: np.ndarray) -> bytes:
    return _squeeze(c.astype(np.int64)) if len(c) else b""


def _pack(nbytes: int, rows: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        seq, ids, held, sizes, texts, size = 0, [], [], [], [], 0

        def block():
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                    pa.array([sizes], pa.list_(pa.int32())), pa.array([blob], pa.binary()),
                ],
                ["block", "ids", "held", "sizes", "texts"],
            )

        for b in batches:
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if ids and (size + len(raw) > nbytes or len(ids) >= rows):
                    yield block()
                    seq, ids, held, sizes, texts, size = seq + 1, [], [], [], [], 0
                ids.append(i)
                held.append(h)
                sizes.append(len(raw))
                texts.append(raw)
                size += len(raw)
        if ids:
            yield block()

    return go


class Tokens:
    """The tokens of a block in text order, as numbers of its own: 1 the start, 2 the end, 3 and up its words.

    ``here``: all tokens, an end after each text; ``lengths``: tokens of each text; ``hashes``: number -> 64-bit hash."""

    def __init__(self, sizes: list[int], blob: bytes):
        raw = zstandard.ZstdDecompressor().decompress(blob) if any(sizes) else b""
        number: dict[bytes, int] = {}
        found, at = [], 0
        self.lengths = np.ones(len(sizes), np.int64)
        for i, size in enumerate(sizes):
            for piece in _pieces(raw, at, at + size):
                words = piece.translate(LOWER).split()
                for w in words:
                    if w not in number:
                        number[w] = len(number) + 3
                found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                self.lengths[i] += len(words)
            found.append(np.array([_END], np.int32))
            at += size
        self.here = np.concatenate(found) if found else np.zeros(0, np.int32)
        self.hashes = np.array([0, _START_HASH, _END_HASH, *map(xxhash.xxh3_64_intdigest, number)], np.uint64)

    def bigrams(self) -> np.ndarray:
        """Token before << 32 | token, for each token."""
        before = np.empty(len(self.here), np.int64)
        before[1:] = self.here[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = _START
        return before << 32 | self.here


def _pieces(raw: bytes, at: int, end: int) -> Iterator[bytes]:
    """A text in pieces of about ``_PIECE`` bytes, cut at white space."""
    while end - at > _PIECE:
        cut = _SPACE.search(raw, at + _PIECE, end)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.end()
    yield raw[at:end]


class Counts:
    """Distinct words and bigrams of a block, by the block's own numbers, with counts in its training texts (may be 0)."""

    def __init__(self, tokens: Tokens, held: np.ndarray):
        train = np.repeat(~held, tokens.lengths)
        marked = np.sort(tokens.bigrams() << 1 | train)
        self.bigrams, n = runs(marked >> 1)
        self.bigram_counts = np.add.reduceat(marked & 1, np.cumsum(n) - n) if len(n) else np.zeros(0, np.int64)
        self.words, _ = runs(np.sort(tokens.here))
        self.word_counts = np.bincount(tokens.here[train], minlength=len(tokens.hashes)).astype(np.int64)
        h = tokens.hashes
        self.keys = [mix(h[self.words]), pair_key(h[self.bigrams >> 32], h[self.bigrams & 0xFFFFFFFF])]
        self.order = [np.argsort(k) for k in self.keys]

    def by_key(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(keys in order, counts) of words and of bigrams."""
        counts = [self.word_counts[self.words], self.bigram_counts]
        return [(k[o], c[o]) for k, o, c in zip(self.keys, self.order, counts)]

    def put(self, kind: int, keys: np.ndarray, totals: np.ndarray) -> None:
        """Takes the totals of all training text in place of the block's own counts."""
        at = self.order[kind][find(self.keys[kind][self.order[kind]], keys)]
        if kind:
            self.bigram_counts[at] = totals
        else:
            self.word_counts[self.words[at]] = totals


def _list_keys(bits: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rows = []
                table = Counts(Tokens(row["sizes"], row["texts"]), np.array(row["held"], bool))
                for kind, (keys, counts) in enumerate(table.by_key()):
                    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    which, n = runs(part)
                    for p, e, k in zip(which.tolist(), np.cumsum(n).tolist(), n.tolist()):
                        rows.append((kind, p, row["block"], _squeeze_keys(keys[e - k : e]), _squeeze_counts(counts[e - k : e])))
                kinds, parts, blocks, keys, counts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(parts, pa.int64()), pa.array(blocks, pa.int64()), pa.array(keys), pa.array(counts)],
                    ["kind", "part", "block", "keys", "counts"],
                )

    return go


def _total(g: pd.DataFrame) -> pd.DataFrame:
    """Adds up a key range; each block gets the totals that exceed its own counts."""
    keys = [_expand_keys(x) for x in g["keys"]]
    counts = [_expand_counts(x) for x in g["counts"]]
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")  # merges sorted runs
    distinct, n = runs(all_keys[order])
    totals = np.add.reduceat(all_counts[order], np.cumsum(n) - n)
    total = np.empty(len(all_keys), np.int64)
    total[order] = np.repeat(totals, n)
    rows, at, kind = [], 0, int(g["kind"].iloc[0])
    for block, k, c in zip(g["block"], keys, counts):
        t = total[at : at + len(k)]
        at += len(k)
        more = t > c
        if more.any():
            rows.append((block, kind, _squeeze_keys(k[more]), _squeeze_counts(t[more]), None, None))
    if kind == 0:
        rows.append((-1, 0, b"", b"", int(totals.sum()), int((totals > 0).sum())))
    return pd.DataFrame(rows, columns=["block", "kind", "keys", "counts", "tokens", "types"])


class Automaton:
    """The part of the weighted automaton that the texts of a block can reach.

    States: ``_ROOT``, ``_START`` and one for each word that training has.  The root has an arc for every word; any
    other state one for each bigram of training, and a failure arc to the root.  Weights are log10 probabilities.
    """

    def __init__(self, table: Counts, tokens: int, types: int, prior: float):
        c = table.word_counts.astype(np.float64)
        root = (c + 1.0) / (tokens + types + 1)
        self.root_weight = np.log10(root)
        self.root_to = np.where(c > 0, np.arange(len(c)), _ROOT)  # also where any other arc of that word leads
        seen = c.copy()
        seen[_START] = c[_END]  # each text starts once and ends once
        self.fail_weight = np.log10(prior / (seen + prior))
        self.fail_weight[_ROOT] = 0.0  # reads every word itself
        has = table.bigram_counts > 0
        self.arcs = table.bigrams[has]  # state << 32 | word, in order
        state, word = self.arcs >> 32, self.arcs & 0xFFFFFFFF
        self.arc_weight = np.log10((table.bigram_counts[has] + prior * root[word]) / (seen[state] + prior))
        self.arc_to = self.root_to[word]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each state reads a word by its arc, or fails to the root and reads it there: (weights, next states)."""
        weight = self.fail_weight[state] + self.root_weight[word]
        to = self.root_to[word]
        if len(self.arcs):
            key = state << 32 | word
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = np.flatnonzero(self.arcs[at] == key)
            weight[hit] = self.arc_weight[at[hit]]
            to[hit] = self.arc_to[at[hit]]
        return weight, to

    def traverse(self, here: np.ndarray, lengths: np.ndarray, lane: int = 512) -> np.ndarray:
        """The weight of each token.  Texts are read left to right side by side, each lane carrying its state; a long
        text is cut into lanes, which start with the word before the cut, read from the root: one word fixes the state."""
        first = np.cumsum(lengths) - lengths
        cuts = -(-lengths // lane)
        part = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.repeat(first, cuts) + part * lane
        size = np.minimum(np.repeat(lengths, cuts) - part * lane, lane)
        order = np.argsort(-size, kind="stable")
        start, size, part = start[order], size[order], part[order]
        state = np.full(len(start), _START, np.int64)
        later = part > 0
        _, state[later] = self.step(np.full(int(later.sum()), _ROOT, np.int64), here[start[later] - 1])
        out = np.empty(len(here))
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t))  # lanes longer than t
            at = start[:live] + t
            out[at], state[:live] = self.step(state[:live], here[at])
        return out


def _score(prior: float, tokens: int, types: int):
    def go(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(left):
            return pd.DataFrame({c: [] for c in cols})
        row = left.iloc[0]
        held = np.array(row["held"], bool)
        text = Tokens([int(x) for x in row["sizes"]], row["texts"])
        table = Counts(text, held)
        for kind, raw, c in zip(right["kind"], right["keys"], right["counts"]):
            table.put(kind, _expand_keys(raw), _expand_counts(c))
        at = np.cumsum(text.lengths) - text.lengths
        base = np.log10(table.word_counts + 1.0) - np.log10(float(tokens + types + 1))
        weight = Automaton(table, tokens, types, prior).traverse(text.here, text.lengths)
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in row["ids"]], dtype="Int64"),
                "held_out": held, "n_tokens": text.lengths,
                "n_known": np.add.reduceat((table.word_counts > 0).astype(np.int64)[text.here], at),
                "train_tokens": tokens, "base_score": np.add.reduceat(base[text.here], at), "score": np.add.reduceat(weight, at),
            }
        )

    return go


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2, prior: float = 300.0, block_bytes: int = 12 << 20, block_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    rows = id_and_text(docs).withColumn("held", held_out("doc_id", folds, fold))
    blocks = scratch.table(rows.mapInArrow(_pack(block_bytes, block_rows), _BLOCK_SCHEMA), "lm-blocks")
    # Key ranges of about a block's worth of keys each (16 bytes a distinct word or bigram).
    bits = max(2, (blocks.count() // 2).bit_length())
    keys = blocks.mapInArrow(_list_keys(bits), _KEY_SCHEMA)
    back = scratch.table(keys.groupBy("kind", "part").applyInPandas(_total, _BACK_SCHEMA), "lm-totals")
    n = back.filter("block = -1").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(n[0] or 0), int(n[1] or 0)
    totals = back.filter("block <> -1").select("block", "kind", "keys", "counts")
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(_score(prior, tokens, types), _OUT)
    return scratch.result(scored, "lm-scores")
