r"""Benchmark decontamination with one FM-index per shard of training text.

A shard is a few megabytes of whole documents.  Its words become symbols of the test set's alphabet;
a word the test set doesn't know can't be part of a window, so it ends a run, and runs shorter than
the shortest window are left out.  Longer runs are cut into blocks that overlap by a window less one
word, each closed by an end mark, which bounds the depth of the suffix sort.  The Burrows-Wheeler
transform of all blocks is kept as a wavelet matrix; backward search finds the rows of every window,
all windows at once, and positions come from suffix positions sampled every ``rate`` words, reached
by last-to-first steps.  Occurrences merge to word ranges and removal spans.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of A-Z lower-cased text.  A window is ``width``
consecutive words of an item; an item of fewer, but not none, is one window.

The test set is read in blocks of bounded size, one pass each, so no more than a block is ever
broadcast; results of several blocks are merged by row.

Defined results: null or empty text has no words and is clean; items without words have no window;
items that share an id count once, an item without id hits words but isn't listed; rows with equal
ids keep their own row; an empty test set leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, rows_that_stay, runs, slices

#: Upper case to lower, every ASCII byte that isn't a letter or digit to a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BLOCK = 48
_OUT = "rid long, doc_id long, n_words long, n_hit long, ranges array<int>, items array<long>, spans array<int>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class TestSet:
    """Windows of some items as symbol rows, longest ``width``."""

    __test__ = False

    def __init__(self, items: list[tuple[int | None, bytes | None]], width: int):
        self.width = width
        self.symbols: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[at : at + width]), set()).add(item)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.rows = np.zeros((len(windows), width), np.int64)  # aligned at the end
        for k, w in enumerate(windows):
            self.rows[k, width - len(w) :] = w
        self.items = [sorted(x for x in s if x is not None) for s in windows.values()]
        self.shortest = int(self.lengths.min()) if len(windows) else 1


def _ahead(rank: np.ndarray, to_end: np.ndarray, k: int) -> np.ndarray:
    """Ranks ``k`` places on, 0 past the end mark."""
    ahead = np.zeros(len(rank), np.uint64)
    if k < len(rank):
        ahead[:-k] = rank[k:]
        ahead[to_end < k] = 0
    return ahead


def suffix_order(symbols: np.ndarray, to_end: np.ndarray, depth: int) -> np.ndarray:
    """Order of suffixes cut at their end mark; equal ones by place.  ``to_end``: symbols up to the mark."""
    n = len(symbols)
    place_bits = max(1, int(n - 1).bit_length())
    places = np.arange(n, dtype=np.uint64)
    mask = np.uint64((1 << place_bits) - 1)
    rank, width = symbols.astype(np.uint64), 1
    while True:
        bits = max(1, int(rank.max()).bit_length())
        parts = max(1, min((64 - place_bits) // bits, -(-depth // width)))
        if parts == 1:  # a key doesn't hold two ranks beside the place: sort by two keys
            ahead = _ahead(rank, to_end, width)
            at = np.lexsort((ahead, rank))
            width *= 2
            if width >= depth:
                return at
            key, ahead = rank[at], ahead[at]
            fresh = np.empty(n, np.uint64)
            fresh[at] = np.cumsum(np.concatenate(([1], (key[1:] != key[:-1]) | (ahead[1:] != ahead[:-1])))).astype(np.uint64)
            rank = fresh
            continue
        key = rank.copy()
        for j in range(1, parts):
            key = key << np.uint64(bits) | _ahead(rank, to_end, j * width)
        order = np.sort(key << np.uint64(place_bits) | places)
        at = (order & mask).astype(np.int64)
        width *= parts
        if width >= depth:
            return at
        key = order >> np.uint64(place_bits)
        fresh = np.empty(n, np.uint64)
        fresh[at] = np.cumsum(np.concatenate(([1], key[1:] != key[:-1]))).astype(np.uint64)
        rank = fresh


class WaveletMatrix:
    """Ranks of symbols in a sequence: a level for each bit, the highest first, with zeros before ones."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.zeros, self.split = bits, [], []
        for level in range(bits - 1, -1, -1):
            one = (s >> level) & 1
            zeros = np.zeros(len(s) + 1, np.int32)
            np.cumsum(1 - one, out=zeros[1:])
            self.zeros.append(zeros)
            self.split.append(int(zeros[-1]))
            s = np.concatenate((s[one == 0], s[one == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before a place, plus where that symbol starts on the lowest level."""
        for k, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            z = zeros[at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, split + at - z, z)
        return at

    def symbol_and_place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its place on the lowest level."""
        symbol = np.zeros(len(at), np.int64)
        for zeros, split in zip(self.zeros, self.split):
            z = zeros[at]
            one = zeros[at + 1] == z
            symbol = symbol << 1 | one
            at = np.where(one, split + at - z, z)
        return symbol, at


class FMIndex:
    def __init__(self, symbols: np.ndarray, to_end: np.ndarray, depth: int, rate: int = 8):
        order = suffix_order(symbols, to_end, depth)
        alphabet = int(symbols.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet))))
        self.wavelet = WaveletMatrix(symbols[order - 1], max(1, int(alphabet - 1).bit_length()))
        self.base = self.wavelet.rank(np.arange(alphabet), np.zeros(alphabet, np.int64))
        # Steps never leave a block: its first symbol is always sampled, as the one before is an end mark.
        sampled = (order % rate == 0) | (symbols[order - 1] == 0)
        self.sampled = sampled
        self.sample_no = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each pattern (symbols aligned at the end, 0 before)."""
        n = len(self.sampled)
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64)
        live = np.arange(len(rows))
        for col in range(rows.shape[1] - 1, -1, -1):
            c = rows[live, col]
            step = (c > 0) & (c < len(self.base))
            gone = live[c >= len(self.base)]
            hi[gone] = lo[gone]
            live, c = live[step], c[step]
            if not len(live):
                break
            both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((lo[live], hi[live])))
            start = self.first[c] - self.base[c]
            lo[live], hi[live] = both[: len(c)] + start, both[len(c) :] + start
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        at, steps, out, who = at.copy(), 0, np.empty(len(at), np.int64), np.arange(len(at))
        while len(at):
            known = self.sampled[at]
            out[who[known]] = self.samples[self.sample_no[at[known]]] + steps
            at, who = at[~known], who[~known]
            c, place = self.wavelet.symbol_and_place(at)
            at = place - self.base[c] + self.first[c]
            steps += 1
        return out


def _blocks(symbols: np.ndarray, doc: np.ndarray, shortest: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with end marks (0), the word each comes from, and the distance to the end mark."""
    known = symbols > 0
    edge = np.flatnonzero(np.concatenate(([True], (known[1:] != known[:-1]) | (doc[1:] != doc[:-1]), [True])))
    start, length = edge[:-1], np.diff(edge)
    keep = known[start] & (length >= shortest)
    start, length = start[keep], length[keep]
    if not len(start):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    stride = _BLOCK - width + 1
    pieces = np.maximum(1, -(-(length - width + 1) // stride))
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    offset = nth * stride
    start = np.repeat(start, pieces) + offset
    length = np.minimum(_BLOCK, np.repeat(length, pieces) - offset)
    total = length + 1
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    to_end = np.repeat(length, total) - at
    word = np.repeat(start, total) + at
    text = np.where(to_end > 0, symbols[np.minimum(word, len(symbols) - 1)], 0)
    return text, word, to_end


def shard_hits(texts: list, test: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a shard: words of each text, hit flag of each word, and distinct (text, window) pairs."""
    get = test.symbols.get
    symbols: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words_of(t)
        counts[i] = len(w)
        symbols += [get(x, 0) for x in w]
    s = np.array(symbols, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    none = np.zeros((0, 2), np.int64)
    if not len(s) or not len(test.rows):
        return counts, np.zeros(len(s), bool), none
    text, word, to_end = _blocks(s, doc, test.shortest, test.width)
    if not len(text):
        return counts, np.zeros(len(s), bool), none
    index = FMIndex(text, to_end, _BLOCK + 1)
    lo, hi = index.search(test.rows)
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = word[index.locate(rows)]
    change = np.zeros(len(s) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + test.lengths[window], -1)
    pairs, _ = runs(np.sort(doc[at] * len(test.rows) + window))
    return counts, np.cumsum(change[:-1]) > 0, np.stack((pairs // len(test.rows), pairs % len(test.rows)), 1)


def _ranges(hit: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()


def _spans(text: bytes, ranges: list[int]) -> list[int]:
    """Code points from the first to past the last word of each word range."""
    at = [m.span() for m in _WORD.finditer(text.decode())]
    return [x for i in range(0, len(ranges), 2) for x in (at[ranges[i]][0], at[ranges[i + 1] - 1][1])]


def _match(test: TestSet):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for ids, texts in slices(iter([b]), rows=4096, nbytes=6 << 20):
                rids = b.column(2).slice(done, len(ids))
                done += len(ids)
                counts, hit, pairs = shard_hits(texts, test)
                ends = np.cumsum(counts)
                items: list[list[int]] = [[] for _ in ids]
                for d, w in pairs.tolist():
                    items[d] += test.items[w]
                n_hit, ranges, spans = [], [], []
                for i, t in enumerate(texts):
                    own = hit[ends[i] - counts[i] : ends[i]]
                    k = int(own.sum())
                    n_hit.append(k)
                    ranges.append(_ranges(own) if k else [])
                    spans.append(_spans(t, ranges[-1]) if k else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        rids, pa.array(ids, pa.int64()), pa.array(counts), pa.array(n_hit, pa.int64()),
                        pa.array(ranges, pa.list_(pa.int32())), pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int32())),
                    ],
                    ["rid", "doc_id", "n_words", "n_hit", "ranges", "items", "spans"],
                )

    return go


def _union(ranges) -> list[int]:
    out: list[int] = []
    for a, b in sorted((r[i], r[i + 1]) for r in ranges for i in range(0, len(r), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return [int(x) for x in out]


def _merge(g: pd.DataFrame) -> pd.DataFrame:
    """One row from the results of all test-set blocks for it."""
    ranges = _union(g["ranges"])
    spans = _union(g["spans"])
    first = g.iloc[:1].copy()
    first["n_hit"] = sum(b - a for a, b in zip(ranges[::2], ranges[1::2]))
    first["ranges"], first["spans"] = [ranges], [spans]
    first["items"] = [sorted({int(x) for items in g["items"] for x in items})]
    return first


def test_blocks(benchmark: DataFrame, width: int, max_bytes: int) -> Iterator[TestSet]:
    """The test set in blocks of at most ``max_bytes`` of text (or one item)."""
    items, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").cast("binary").alias("t"))
    for r in rows.filter(F.col("t").isNotNull()).toLocalIterator():
        if items and size + len(r["t"]) > max_bytes:
            yield TestSet(items, width)
            items, size = [], 0
        items.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    yield TestSet(items, width)


test_blocks.__test__ = False


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no window of the benchmark: a pass of each block of it."""
    for block in test_blocks(benchmark, width, max_bytes):

        def goes(test=block):
            def judge(texts: list) -> list[bool]:
                counts, hit, _ = shard_hits(texts, test)
                ends = np.cumsum(counts)
                return [bool(hit[e - n : e].any()) for e, n in zip(ends.tolist(), np.asarray(counts).tolist())]

            return judge

        docs = rows_that_stay(docs, goes)
    return docs


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids with occurring windows), spans (struct<start,end>, code points) per row."""
    spark = docs.sparkSession
    blocks = test_blocks(benchmark, width, max_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        rows = id_and_text(docs).withColumn("rid", F.lit(0).cast("long"))
        found = rows.mapInArrow(_match(first), _OUT)
    else:
        scratch = Scratch(spark)
        rows = scratch.table(id_and_text(docs).withColumn("rid", F.monotonically_increasing_id()), "decontam-docs")
        found = None
        for block in (first, second, *blocks):
            part = scratch.table(rows.mapInArrow(_match(block), _OUT), "decontam-hits")
            found = part if found is None else found.unionByName(part)
        found = found.groupBy("rid").applyInPandas(_merge, _OUT)
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(0) + F.greatest(F.size("spans") / 2 - 1, F.lit(0)).cast("int")),
        lambda i: F.struct(F.get("spans", i * 2).alias("start"), F.get("spans", i * 2 + 1).alias("end")),
    )
    return found.select("doc_id", "n_words", "n_hit", "items", F.filter(pairs, lambda p: p["end"].isNotNull()).alias("spans"))
