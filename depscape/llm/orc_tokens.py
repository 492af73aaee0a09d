"""Token-id output: ORC files with run-length encoded ids, row indexes and Bloom filters.

Documents are range-partitioned by id, encoded, and written in ascending id order, one ORC file a
range.  ORC stores the integer lists with its run-length encoding (version 2), a row index every
``row_index_stride`` rows, and a Bloom filter on the document id, so that a reader fetches stripes
in parallel and skips those that can't hold an id.  ``start`` (ids before a document) is a prefix
sum: sums within a file plus the totals of the files before, both read back from the files.

The byte-pair tokenizer works on pieces of a text: a space between two characters that aren't
white space always begins a new piece, so ids of a piece are remembered and reused; texts with
other runs of white space are one piece.  The library's model encodes the pieces that a slice of texts adds, many words in one
call: no merge of the vocabulary joins a word with a space after it (else it encodes each alone), so the ids of words with a
space before each are those of the words, and each word's first id is one that begins with a space.  The memo is bounded; it changes no result.
A text that holds an added token of the vocabulary file (``<|endoftext|>``) goes through the library whole.
``encode_special_tokens`` is the library's setting of that name: with it such a token is ordinary text.

Defined results: null or empty text has only the end id; rows with equal ids keep their own row, by
text; rows with a null id come first; an empty table writes no rows and returns none.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, scratch_path, slices


_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"

#: Text of ASCII and Latin letters alone.
_PLAIN = re.compile(f"[\0-\x7f{_LATIN}]*").fullmatch


#: The pre-token pattern on such text.
_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9{_LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
).findall


#: Pieces a worker remembers before those that aren't used again go.
MEMO = 500_000

#: Words that go through the library's model in one call.
CALL = 128


def _no_merge_before_a_space(tokenizer, byte_of: dict[str, int]) -> bool:
    """Whether the model's ids of words that each begin with their only space are those of the words joined."""
    model = json.loads(tokenizer.to_str())["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    for token in model["vocab"]:
        if not all(c in byte_of for c in token):
            continue  # an added token, which no merge makes
        raw = bytes(byte_of[c] for c in token)
        at = raw.find(b" ", 1)
        while at > 0:  # only white space, which no word ends in, may stand before
            before = raw[:at].decode(errors="replace")[-1]
            if not before.isspace() or before in "\x1c\x1d\x1e\x1f":  # those four are no white space to the pre-token pattern
                return False
            at = raw.find(b" ", at + 1)
    return True


class PieceIds:
    """Ids (little-endian uint32 bytes) of whole texts by the tokenizers library, with a memo of pieces."""

    def __init__(self, path: str, encode_special_tokens: bool, most: int = MEMO):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(path)
        full.encode_special_tokens = encode_special_tokens
        self.full, self.model = full, full.model
        added = [t.content for t in full.get_added_tokens_decoder().values() if not (t.special and encode_special_tokens)]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda t: None
        self.any_split = regex.compile(public_tokenizers.PATTERN).findall
        self.most = most
        self.memo: dict[str, bytes] = {}  # piece without its leading space -> ids
        self.old: dict[str, bytes] = {}  # the memo before this one
        self.words: dict[str, bytes] = {}  # pre-tokens without a leading space
        # Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))
        self.call = CALL if _no_merge_before_a_space(full, {c: b for b, c in enumerate(self.alphabet)}) else 1
        size = full.get_vocab_size()
        self.spaced = np.array([(full.id_to_token(i) or "").startswith(self.alphabet[32]) for i in range(size)], bool)

    def ids(self, text: str) -> np.ndarray:
        """The model's ids of one pre-token, or of words that it can't merge with each other."""
        shown = codecs.charmap_decode(text.encode(), "strict", self.alphabet)[0]
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4")

    def spaced_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of many pre-tokens that begin with their only space, several in one call of the model."""
        if self.call == 1:
            return [self.ids(w).tobytes() for w in words]
        out = []
        for i in range(0, len(words), self.call):
            got = self.ids("".join(words[i : i + self.call]))
            raw, at = got.tobytes(), (4 * np.flatnonzero(self.spaced[got])).tolist()
            out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
        return out

    def word(self, w: str) -> bytes:
        """Ids of one pre-token without a leading space."""
        ids = self.words.get(w)
        if ids is None:
            ids = self.words[w] = self.ids(w).tobytes()
        return ids

    def split(self, text: str) -> list[str]:
        return (_SPLIT if _PLAIN(text) else self.any_split)(text)

    def whole(self, text: str) -> bytes:
        """Ids of a text or its first piece: of each pre-token, by the library's model."""
        out = []
        for w in self.split(text):
            if w[0] != " " or len(w) == 1 or w[-1].isspace():
                out.append(self.word(w))
                continue
            ids = self.memo.get(w[1:]) or self.old.get(w[1:]) or self.ids(w).tobytes()
            self.memo[w[1:]] = ids
            out.append(ids)
        return b"".join(out)

    def learn(self, pieces: list[str]) -> None:
        """Adds pieces to the memo; those that are empty or have white space at their ends are left out."""
        new = []
        for p, ids in zip(pieces, map(self.old.get, pieces)):
            if ids is not None:
                self.memo[p] = ids
            elif p and not p[0].isspace() and not p[-1].isspace():
                new.append(p)
        if not _PLAIN("".join(new)):
            plain = [p for p in new if _PLAIN(p)]
            self.learn_new([p for p in new if not _PLAIN(p)], self.any_split)
            new = plain
        self.learn_new(new, _SPLIT)

    def learn_new(self, pieces: list[str], split: Callable[[str], list[str]]) -> None:
        if not pieces:
            return
        words = split(" " + " ".join(pieces))  # a space begins a pre-token, and only a piece has one
        out = []
        firsts = iter(self.spaced_words([w for w in words if w[0] == " "]))
        for w in words:
            if w[0] == " ":
                out.append(next(firsts))
            else:
                out[-1] += self.word(w)
        self.memo.update(zip(pieces, out, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) >= self.most:  # what is used again moves on from the old pieces
            self.memo, self.old = {}, self.memo
        if len(self.words) >= self.most:
            self.words.clear()
        pieces: list[str] = []
        ends = []  # of each text's pieces after the first; None: it goes through the library whole
        for t in texts:
            if t and self.added(t):
                ends.append(None)
            else:
                pieces += (t or "").split(" ")
                ends.append(len(pieces))
        got = list(map(self.memo.get, pieces))
        starts = [0, *(e for e in ends if e is not None)][:-1]
        for i in starts:
            got[i] = b""  # a first piece has no space before it
        missing = [i for i, ids in enumerate(got) if ids is None]
        self.learn(list(dict.fromkeys(map(pieces.__getitem__, missing))))
        odd = []  # pieces before which no pre-token begins for certain
        for i in missing:
            got[i] = self.memo.get(pieces[i])
            if got[i] is None:
                odd.append(i)
        odd = set(np.searchsorted(starts, odd, "right").tolist()) if odd else ()
        out, at, n = [], 0, 0
        for t, end in zip(texts, ends):
            if end is None:
                out.append(np.array(self.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            n += 1
            first = pieces[at]
            if not t:
                out.append(b"")
            elif n in odd or not first or first[-1].isspace():
                out.append(self.whole(t))
            else:
                out.append(self.whole(first) + b"".join(got[at + 1 : end]))
            at = end
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, encode_special_tokens: bool, memo: int) -> PieceIds:
    """One for each Python worker; later tasks reuse its memo."""
    return PieceIds(path, encode_special_tokens, memo)


def _encode(path: str, end_id: int, encode_special_tokens: bool, memo: int):
    end = np.array([end_id], "<u4").tobytes()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, encode_special_tokens, memo)
        for ids, texts in slices(batches, rows=1024, nbytes=1 << 20):
            got = encoder.encode([t.decode() if t is not None else None for t in texts])
            raw = b"".join(x + end for x in got)
            sizes = np.array([len(x) // 4 + 1 for x in got], np.int64)
            at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(raw, "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(sizes)], ["doc_id", "ids", "n_tokens"])

    return go


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_index_stride: int = 1000, stripe: int = 32 << 20, encode_special_tokens: bool = True, memo: int = MEMO) -> None:
    """Writes ORC rows (doc_id, ids, n_tokens, file_no) in ascending doc_id order under ``path``."""
    rows = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = rows.mapInArrow(_encode(tokenizer, end_id, encode_special_tokens, memo), "doc_id long, ids array<int>, n_tokens long")
    (
        encoded.withColumn("file_no", F.spark_partition_id())
        .write.option("compression", "zstd")
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.stripe.size", stripe)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        n = np.diff(at).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n), pa.array(crc, pa.int64()), b.column(2), b.column(3)], ["doc_id", "n_tokens", "ids_crc32", "file_no", "seq"]
        )


def read_tokens(spark, path: str) -> DataFrame:
    """The written rows: doc_id, ids, n_tokens, file_no.  Filters on doc_id reach stripes and row groups."""
    return spark.read.schema("doc_id long, ids array<int>, n_tokens long, file_no int").orc(path)


def token_index(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all computed from the written files."""
    # Rows of a file stay in written order within a split, and monotonically_increasing_id orders splits of a file.
    rows = read_tokens(spark, path).withColumn("seq", F.monotonically_increasing_id())
    digests = rows.select("doc_id", "ids", "file_no", "seq").mapInArrow(
        _crc, "doc_id long, n_tokens long, ids_crc32 long, file_no int, seq long"
    )
    totals = read_tokens(spark, path).groupBy("file_no").agg(F.sum("n_tokens").alias("n")).collect()  # one row a file
    before, offset = 0, []
    for r in sorted(totals, key=lambda r: r["file_no"]):
        offset.append((r["file_no"], before))
        before += r["n"]
    if not offset:
        return digests.select("doc_id", F.lit(0).cast("long").alias("start"), "n_tokens", "ids_crc32")
    w = Window.partitionBy("file_no").orderBy(F.asc_nulls_first("doc_id"), "seq")
    within = F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    offsets = F.create_map(*[F.lit(x) for kv in offset for x in (int(kv[0]), int(kv[1]))])
    start = (F.element_at(offsets, F.col("file_no")) + within).cast("long")
    return digests.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, encode_special_tokens: bool = True, memo: int = MEMO) -> DataFrame:
    """Writes the ORC files (in the shared scratch folder unless ``path`` is given) and returns their index.

    ``memo``: pieces a worker remembers, about 0.5 MB a thousand; fewer cost time and change no result."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, encode_special_tokens=encode_special_tokens, memo=memo)
    return token_index(spark, path)
