r"""Near-duplicate groups by bottom-k sketches from one hash function.

A document's set is its distinct word shingles (``shingle`` words; fewer words make one shingle of
the whole sequence).  One hash function orders all shingles, and the ``k`` smallest values of a set
are its sketch.  Documents with equal sets are one class from then on.

*Inverted lists.*  Two sets of similarity ``j`` or more share at least ``need`` sketch values (for small
sets that is certain; for others it fails with a binomial probability, below 1e-7 for the defaults).
So it is enough to index, of each sketch, all but its ``need - 1`` most frequent values: common
phrases drop out of the inverted lists by themselves and no list needs a cap.

*Overlaps.*  Lists with the same pivot (their member with the fewest values of its own, ties by hash)
are taken together, so that a group of copies, which meets in many lists, is looked at about once.  A
group beyond ``TILE_ROWS`` classes or ``TILE_ITEMS`` shingles is dealt into buckets by hash, and each pair
of buckets is a tile, so that no task sees an unbounded group and no pair is left out.  Within a tile
all sketch overlaps are one matrix product.

*Filter and check.*  Classes of fitting size with enough of the union's sketch in common are likely;
the likely neighbourhoods of each tile go on with their texts, and the exact Jaccard similarity
of the full sets, again from matrix products, decides.  What leaves a tile is a star for each of its
linked groups, never a list of pairs: rows grow in proportion to documents, whatever the groups' size.

*Components* come from minimum labels spread along the stars with pointer jumping; everything stays in
tables.

Sets are of 63-bit hashes; classes are 128-bit digests of sets.

Defined results: null text, or text without words, has an empty set and links with nothing; rows with
equal ids keep their own row; a null id takes part in no link and keeps itself (component null); an
empty table gives an empty result; further columns of ``docs`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, id_and_text, mix, release_shuffles, slices, word_hashes

K, NEED = 32, 12
#: Bounds of a tile's bucket, and the share of rows above which a key is joined apart.
TILE_ROWS, TILE_ITEMS, HOT = 1024, 1 << 20, 1000
#: Words whose hashes a task remembers.
MEMO = 300_000


def shingle_sets(texts: list, shingle: int, memo: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 63-bit shingle hashes of each text."""
    words, counts = word_hashes(texts, memo)
    h = mix(words)
    keys = h.copy()
    for j in range(1, shingle):
        keys[: len(keys) - j] = mix(keys[: len(keys) - j] * np.uint64(3) + h[j:])
    keys >>= np.uint64(1)
    out, at = [], 0
    for n in counts.tolist():
        if n >= shingle:
            s = np.sort(keys[at : at + n - shingle + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            whole = h[at : at + 1]
            for j in range(1, n):
                whole = mix(whole * np.uint64(3) + h[at + j : at + j + 1])
            s = mix(whole + np.uint64(n)) >> np.uint64(1)
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        at += n
    return out


def class_of(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _sketch(shingle: int, k: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes(MEMO)
        for ids, texts in slices(batches):
            sets = shingle_sets(texts, shingle, memo)
            low = [s[:k].astype(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(low, pa.list_(pa.int64())),
                    pa.array([s.astype(np.uint32).tobytes() for s in low], pa.binary()),
                ],
                ["doc_id", "n", "cls", "sketch", "mini"],
            )

    return go


def overlaps(rows: np.ndarray, values: np.ndarray, n: int, block: int = 4096) -> np.ndarray:
    """How many values each two of ``n`` rows have in common; (row, value) entries are distinct."""
    order = np.argsort(values, kind="stable")
    r, v = rows[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    times = np.diff(np.concatenate((first, [len(v)])))
    each = np.repeat(times, times)
    light = (each <= 16) if n > 64 else np.zeros(len(each), bool)
    out = np.zeros((n, n), np.float32)
    if light.any():  # values of few rows: their pairs, counted by place
        lr, lv = r[light], v[light]
        for d in range(1, 16):
            same = np.flatnonzero(lv[d:] == lv[:-d])
            if not len(same):
                break
            x, y = lr[same], lr[same + d]
            out += np.bincount(x * n + y, minlength=n * n).reshape(n, n).astype(np.float32)
        out += out.T
    heavy = ~light & (each > 1)
    hr, hv = r[heavy], v[heavy]
    if len(hr):
        col = np.cumsum(np.concatenate(([0], (hv[1:] != hv[:-1]).astype(np.int64))))
        cuts = np.searchsorted(col, np.arange(0, col[-1] + 1 + block, block))
        for k in range(len(cuts) - 1):
            part = slice(cuts[k], cuts[k + 1])
            held = np.zeros((n, min(block, int(col[-1]) + 1 - k * block)), np.float32)
            held[hr[part], col[part] - k * block] = 1
            out += held @ held.T
    return out


def linked_groups(near: np.ndarray) -> list[np.ndarray]:
    """Connected groups of two rows or more of a symmetric boolean matrix."""
    left = near.any(1)
    out = []
    while left.any():
        frontier = np.flatnonzero(left)[:1]
        left[frontier] = False
        group = [frontier]
        while len(frontier):
            frontier = np.flatnonzero(near[frontier].any(0) & left)
            left[frontier] = False
            group.append(frontier)
        out.append(np.concatenate(group))
    return out


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) of each run of equal values of the first column, over batches sorted by it."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        t = pa.Table.from_batches([b])
        for k in range(len(cuts) - 1):
            own = int(key[cuts[k]])
            if held and own != last:
                yield last, pa.concat_tables(held)
                held = []
            last = own
            held.append(t.slice(cuts[k], cuts[k + 1] - cuts[k]))
    if held:
        yield last, pa.concat_tables(held)


def _likely(similarity: int, k: int, need: int):
    """Of each tile's rows (tile, cls, n, mini), the groups whose members may be similar: (group, cls)."""

    def near(n: np.ndarray, shared: np.ndarray) -> np.ndarray:
        small, large = np.minimum(n[:, None], n[None]), np.maximum(n[:, None], n[None])
        least = -(-similarity * large // 100)
        whole = -(-similarity * (small + large) // (100 + similarity))  # both sketches are whole sets
        ok = shared >= np.where(large <= k, whole, np.minimum(need, least))
        ok &= 100 * small >= similarity * large
        np.fill_diagonal(ok, False)
        return ok

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, members = [], []
        for _, t in groups_of(batches):
            if t.num_rows < 2:
                continue
            cls, minis = t.column(1).to_pylist(), t.column(3).to_pylist()
            n = t.column(2).to_numpy()
            if len(cls) == 2:
                shared = np.full((2, 2), len({*np.frombuffer(minis[0], "u4").tolist()} & {*np.frombuffer(minis[1], "u4").tolist()}))
            else:
                sizes = np.array([len(m) // 4 for m in minis])
                v = np.frombuffer(b"".join(minis), "u4")
                own = np.repeat(np.arange(len(cls)), sizes)
                shared = overlaps(own, v, len(cls))
            for g in linked_groups(near(n, shared)):
                held = sorted(cls[i] for i in g.tolist())
                groups += [xxhash.xxh3_64_intdigest(b"".join(held)) - (1 << 63)] * len(held)
                members += held
            if len(groups) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(members, pa.binary())], ["grp", "cls"])
                groups, members = [], []
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(members, pa.binary())], ["grp", "cls"])

    return go


def _stars(similarity: int, shingle: int):
    """Of each group's rows (group, cls, text), the exact links as stars: (least class, other class)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes(MEMO)
        centres, others = [], []
        for _, t in groups_of(batches):
            named = {}
            wanted, texts = t.column(1).to_pylist(), t.column(2)
            for at in range(0, len(wanted), 256):
                for c, s in zip(wanted[at : at + 256], shingle_sets(texts.slice(at, 256).to_pylist(), shingle, memo)):
                    if class_of(s) == c:  # an id may belong to other texts as well
                        named[c] = s
            cls, sets = list(named), list(named.values())
            if len(cls) < 2:
                continue
            n = np.array([len(s) for s in sets])
            if len(cls) == 2:
                both = len(np.intersect1d(*sets, assume_unique=True))
                shared = np.full((2, 2), both)
            else:
                shared = np.rint(overlaps(np.repeat(np.arange(len(cls)), n), np.concatenate(sets), len(cls))).astype(np.int64)
            near = 100 * shared >= similarity * (n[:, None] + n[None] - shared)
            np.fill_diagonal(near, False)
            for g in linked_groups(near):
                held = [cls[i] for i in g.tolist()]
                centre = min(held)
                rest = [c for c in held if c != centre]
                centres += [centre] * len(rest)
                others += rest
            if len(centres) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(centres, pa.binary()), pa.array(others, pa.binary())], ["a", "b"])
                centres, others = [], []
        yield pa.RecordBatch.from_arrays([pa.array(centres, pa.binary()), pa.array(others, pa.binary())], ["a", "b"])

    return go


class _Dedup:
    def __init__(self, docs: DataFrame, similarity: int, shingle: int, k: int, need: int):
        self.docs, self.similarity, self.shingle, self.k, self.need = docs, similarity, shingle, k, need
        self.scratch = Scratch(docs.sparkSession)
        schema = "doc_id long, n long, cls binary, sketch array<long>, mini binary"
        self.rows, self.total = self.counted(id_and_text(docs).mapInArrow(_sketch(shingle, k), schema), "dedup-sketches")
        # One row a class; partial aggregation takes the copies together before the shuffle.
        self.classes = self.scratch.table(
            self.rows.filter("cls is not null and doc_id is not null")
            .groupBy("cls")
            .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("mini").alias("mini")),
            "dedup-classes",
        )

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Writes a table and counts its rows on the way."""
        seen = Observation()
        out = self.scratch.table(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, int(seen.get.get("n") or 0)

    def joined(self, left: DataFrame, total: int, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
        """left join right, where right's ``weight`` says how many of left's ``total`` rows a key has.  Keys with
        over a HOT-th of the rows, of which there are fewer than HOT, are broadcast; their rows stay where they are."""
        hot = F.broadcast(right.filter(F.col(weight) > total / HOT))
        cold = right.filter(F.col(weight) <= total / HOT)
        rest = left.join(hot.select(key), key, "left_anti").join(cold, key, how)
        return left.join(hot, key).unionByName(rest)

    def lists(self) -> tuple[DataFrame, int]:
        """v, cls, n, alone: the entries of the inverted lists; alone: values of the sketch no other class has."""
        entries, total = self.counted(self.classes.select("cls", "n", F.explode("sketch").alias("v")), "dedup-entries")
        df = self.scratch.table(entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "dedup-df")
        shared = self.joined(entries, total, df, "v", "df").select("cls", "n", F.struct("df", "v").alias("e"))
        need = F.least(F.lit(self.need), F.ceil(F.col("n") * F.lit(self.similarity) / 100)).cast("int")
        held = shared.groupBy("cls", "n").agg(F.sort_array(F.collect_list("e")).alias("es"))  # at most k values
        alone = F.least(F.lit(self.k), F.col("n")) - F.size("es")
        kept = held.select("cls", "n", alone.alias("alone"), F.explode(F.slice("es", 1, F.greatest(F.lit(0), F.size("es") - need + 1))).alias("e"))
        out, n = self.counted(kept.select("e.v", "cls", "n", "alone"), "dedup-lists")
        self.scratch.drop(entries, df)
        return out, n

    def tiles(self) -> DataFrame:
        """tile, cls, n, mini, by tile."""
        lists, total = self.lists()
        order = F.struct("alone", F.xxhash64("cls").alias("h"), F.col("cls").alias("pivot"))
        pivots = lists.groupBy("v").agg(F.count("*").alias("members"), F.min(order).alias("least")).filter("members > 1")
        pivots = self.scratch.table(pivots.select("v", "members", "least.pivot"), "dedup-pivots")
        members = self.joined(lists, total, pivots, "v", "members").select("pivot", "cls", "n").distinct()
        members, total = self.counted(members, "dedup-members")
        self.scratch.drop(lists, pivots)
        buckets = F.ceil(F.greatest(F.col("members") / F.lit(TILE_ROWS), F.col("items") / F.lit(TILE_ITEMS))).cast("int")
        large = members.groupBy("pivot").agg(F.count("*").alias("members"), F.sum("n").alias("items"))
        large = self.scratch.table(large.select("pivot", "members", buckets.alias("m")).filter("m > 1"), "dedup-large")
        dealt = self.joined(members, total, large, "pivot", "members", "left").drop("members").withColumn("m", F.coalesce("m", F.lit(1)))
        dealt = dealt.withColumn("i", F.pmod(F.xxhash64("cls", F.lit(7)), "m").cast("int"))
        dealt = dealt.join(self.classes.select("cls", "mini"), "cls")
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
        tile = F.xxhash64("pivot", F.least("i", "j"), F.greatest("i", "j"))
        return dealt.select(tile.alias("tile"), "cls", "n", "mini").repartition("tile").sortWithinPartitions("tile")

    def links(self) -> DataFrame:
        """a, b: stars of classes whose sets are similar."""
        likely = self.tiles().mapInArrow(_likely(self.similarity, self.k, self.need), "grp long, cls binary").distinct()
        likely = self.scratch.table(likely.join(self.classes.select("cls", "rep"), "cls").select(F.col("rep").alias("doc_id"), "grp", "cls"), "dedup-likely")
        # One plan at every size: texts meet their groups by shuffle.
        texts = id_and_text(self.docs).join(likely.hint("merge"), "doc_id").select("grp", "cls", "text")
        stars = texts.repartition("grp").sortWithinPartitions("grp").mapInArrow(_stars(self.similarity, self.shingle), "a binary, b binary")
        out = self.scratch.table(stars.distinct(), "dedup-links")
        self.scratch.drop(likely)
        return out

    def components(self, links: DataFrame) -> DataFrame:
        """cls, comp for every class with a link: the smallest class it reaches."""
        edges, total = self.counted(links.union(links.select("b", "a")).distinct(), "dedup-edges")
        labels = edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.min("a")).alias("comp"), F.count("*").alias("degree"))
        labels = self.scratch.table(labels, "dedup-labels")
        step = 0
        while True:
            # The least of a class's own label, its label's label and its neighbours' labels.
            near = self.joined(edges, total, labels.toDF("b", "comp", "degree"), "b", "degree").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
            new = labels.join(labels.select(F.col("cls").alias("comp"), F.col("comp").alias("next")), "comp", "left").join(near, "cls")
            new = new.select("cls", F.least("comp", "near", "next").alias("comp"), "degree", F.col("comp").alias("old"))
            seen = Observation()
            new = self.scratch.table(new.observe(seen, F.count_if(F.col("comp") != F.col("old")).alias("n")), f"dedup-labels{step}")
            self.scratch.drop(labels)
            if not seen.get.get("n"):
                self.scratch.drop(edges)
                return new.select("cls", "comp")
            labels = self.scratch.renamed(new, new.drop("old"))
            step += 1


def near_duplicates(docs: DataFrame, similarity: int = 80, shingle: int = 5, k: int = K, need: int = NEED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    job = _Dedup(docs, similarity, shingle, k, need)
    comps = job.components(job.links())
    grouped = job.classes.select("cls", "rep").join(comps, "cls")
    least = job.scratch.table(grouped.groupBy("comp").agg(F.min("rep").alias("component")), "dedup-least")
    of_class = job.classes.select("cls", "rep", "copies").join(comps, "cls", "left").join(least, "comp", "left")
    of_class = job.scratch.table(of_class.select("cls", "copies", F.coalesce("component", "rep").alias("component")), "dedup-components")
    out = job.joined(job.rows.select("doc_id", "n", "cls").filter("cls is not null"), job.total, of_class, "cls", "copies", "left")
    empty = job.rows.filter("cls is null").select("cls", "doc_id", "n", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("long").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.unionByName(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
    result = job.scratch.result(out, "dedup-result")
    del job, comps, grouped, least, of_class, out, empty
    release_shuffles(docs.sparkSession)
    return result
