r"""Personal data by a skip-chain conditional random field over the tokens of a document.

Base patterns find e-mail addresses, IP addresses, card and telephone numbers.  The field then labels
every token that holds a digit or an at sign.  Nodes are such tokens; neighbours in the text share a
linear-chain factor.  Equal or similar tokens anywhere in the document (same letters and digits, same
last seven digits, same local part of an address) are mentions of a key, and so are adjacent tokens of
digits (a card or telephone number in groups) that make the same 7 to 19 digits.  One mention of a key
is its hub, an observed one of each kind if there are any; the hub shares a skip factor with every other
mention, so that evidence for one reaches all, however many and far they are.  Tokens inside base spans
are observed, and no message changes them; the rest is inferred by loopy sum-product message passing
until no message changes by more than ``tolerance``.  A token is added as a span if its marginal for one kind reaches
``threshold`` and either it has that kind's shape or a skip neighbour has that label.

Weights are trained piecewise on a bounded sample (``sample_rows`` documents with a digit or at sign,
of about ten times as many drawn by a hash of the id, of at most ``sample_chars`` code points each): a multinomial logistic
regression for node factors, pointwise mutual information of label pairs for edge factors.

Defined results: null or empty text has no findings; rows with equal ids keep their own row; without
training rows only base spans are found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # label 0: none of them
# The base patterns.  The addresses are searched from their at sign, and a run of digits only
# from its start, which finds the same matches without trying every place of a long run.
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CORE = re.compile(r"[A-Za-z0-9]")
_CUES = (
    re.compile(r"mail|contact|kontakt|courriel|correo|@", re.I),
    re.compile(r"\bip\b|host|addr|server|serv", re.I),
    re.compile(r"card|visa|karte|carte|tarjeta|credit", re.I),
    re.compile(r"phone|tel|call|mobil|fax|handy", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str, digits: bool, at_sign: bool) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match."""
    out = [(s, 0, e) for s, e in _emails(text)] if at_sign else []
    if digits:
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return out


@dataclass
class Nodes:
    """Tokens with a digit or at sign: spans, cores, features, chain and skip edges, observed labels (-1: none)."""

    spans: list[tuple[int, int]]
    texts: list[str]
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    observed: np.ndarray


_BUCKETS = (0, 1, 3, 6, 8, 11, 19)
N_FEATURES = 8 + len(_BUCKETS) + 1 + len(_CUES) + 3


def _features(token: str, before: str) -> np.ndarray:
    f = np.zeros(N_FEATURES)
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    f[0] = 1.0
    f[1] = "@" in token
    f[2] = token.count(".") == 3 and digits > 3 and not letters
    f[3] = token.startswith("+")
    f[4] = "(" in token
    f[5] = "-" in token and not letters
    f[6] = digits > 0 and letters > 0
    f[7] = digits == len(token)
    f[8 + sum(digits > b for b in _BUCKETS)] = 1.0
    at = 8 + len(_BUCKETS) + 1
    for k, cue in enumerate(_CUES):
        f[at + k] = bool(cue.search(before))
    at += len(_CUES)
    f[at] = "=" in token or ":" in token
    f[at + 1] = token.count(".") == 1
    f[at + 2] = len(token) > 24
    return f


def _keys(token: str) -> list[str]:
    core = "".join(_CORE.findall(token)).lower()
    keys = [f"c{core}"] if len(core) >= 5 else []
    digits = "".join(c for c in token if c in "0123456789")
    if len(digits) >= 7:
        keys.append(f"d{digits[-7:]}")
    if "@" in token:
        local = "".join(_CORE.findall(token.split("@")[0])).lower()
        if len(local) >= 5:
            keys.append(f"c{local}")
    return keys


_GROUP = re.compile(r"[+(]*[0-9][0-9().+-]*")
_LEAST, _MOST = 7, 19  # digits of a mention in groups


def _digit_groups(texts: list[str], order: list[int], owner: list[int]) -> dict[str, list[list[int]]]:
    """Digits of 7 to 19 that adjacent tokens make in some place of the document, and the tokens of every mention.

    Of a base span (``owner``: its number, -1 for none) only groups up to its end count, not its first digits."""
    out: dict[str, list[list[int]]] = {}
    grouped: set[str] = set()
    run: list[tuple[int, str]] = []
    for i, t in enumerate(texts):
        core = t.rstrip(".,;:\"'<>[]")
        digits = "".join(c for c in t if c in "0123456789")
        if not _GROUP.fullmatch(core):
            run = []
        else:
            if run and order[i] != order[run[-1][0]] + 1:
                run = []
            run.append((i, digits))
            whole = ""
            inner = owner[i] >= 0 and i + 1 < len(owner) and owner[i + 1] == owner[i]
            for k in range(-1 if inner else len(run) - 1, -1, -1):
                whole = run[k][1] + whole
                if len(whole) > _MOST:
                    break
                if len(whole) >= _LEAST and k < len(run) - 1:
                    grouped.add(whole)
                    mentions = out.setdefault(whole, [])
                    if not mentions or mentions[-1][-1] < run[k][0]:  # they don't overlap
                        mentions.append([x for x, _ in run[k:]])
            if core != t:
                run = []
        for n in range(_LEAST, min(_MOST, len(digits)) + 1):
            out.setdefault(digits[-n:], []).append([i])
    return {k: out[k] for k in grouped if len(out[k]) > 1}


def _skip_pairs(texts: list[str], order: list[int], observed: np.ndarray, owner: list[int]) -> set[tuple[int, int]]:
    """Edges from the hubs of each key to its mentions."""
    seen = observed.tolist()
    pair = lambda a, b: (min(a, b), max(a, b))

    def hubs(nodes: list[int]) -> list[int]:
        first: dict[int, int] = {}
        for i in nodes:
            if seen[i] >= 0:
                first.setdefault(seen[i], i)
        return list(first.values()) or nodes[:1]

    keyed: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        for k in dict.fromkeys(_keys(t)):
            keyed.setdefault(k, []).append(i)
    skip = {pair(h, i) for nodes in keyed.values() if len(nodes) > 1 for h in hubs(nodes) for i in nodes if i != h}
    groups = [(k, [i for m in mentions for i in m]) for k, mentions in _digit_groups(texts, order, owner).items()]
    groups.sort(key=lambda g: (all(seen[i] < 0 for i in g[1]), -len(g[0]), g[0]))
    done: set[int] = set()  # parts of a group that a longer one, or one with an observed mention, has linked
    for _, nodes in groups:
        ends = hubs(nodes)
        left = [i for i in nodes if i not in done]
        skip |= {pair(h, i) for h in ends for i in left if i != h}
        done.update(left)
    return skip


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> Nodes:
    spans, texts, feats, order = [], [], [], []
    before = ("", "")
    for n, m in enumerate(_TOKEN.finditer(text)):
        t = m[0]
        if "@" in t or any(c in t for c in "0123456789"):
            spans.append(m.span())
            texts.append(t)
            feats.append(_features(t.strip(".,;:\"'<>[]"), " ".join(before)))
            order.append(n)
        before = (before[1], t[:24])
    chain = [(i - 1, i) for i in range(1, len(order)) if order[i] == order[i - 1] + 1]
    observed, owner = np.full(len(spans), -1, np.int64), [-1] * len(spans)
    ordered = sorted(base)
    k = 0
    for i, (s, e) in enumerate(spans):
        while k < len(ordered) and ordered[k][2] <= s:
            k += 1
        if k < len(ordered) and ordered[k][0] < e:
            observed[i], owner[i] = ordered[k][1] + 1, k
    skip = _skip_pairs(texts, order, observed, owner)
    pairs = lambda x: np.array(sorted(x), np.int64).reshape(-1, 2)
    return Nodes(spans, texts, np.array(feats).reshape(-1, N_FEATURES), pairs(chain), pairs(skip), observed)


@dataclass
class Weights:
    node: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, log factors
    skip: np.ndarray


def _pmi(pairs: np.ndarray, cap: float = 4.0) -> np.ndarray:
    joint = np.full((LABELS, LABELS), 0.5)
    np.add.at(joint, (pairs[:, 0], pairs[:, 1]), 1.0)
    joint /= joint.sum()
    return np.clip(np.log(joint / np.outer(joint.sum(1), joint.sum(0))), -cap, cap)


def train(texts: list[str], steps: int = 300, rate: float = 0.5, l2: float = 1e-4) -> Weights:
    """Piecewise training with base findings as labels."""
    x, y, chain, skip = [np.zeros((0, N_FEATURES))], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for t in texts:
        n = nodes_of(t, base_spans(t, True, "@" in t))
        label = np.maximum(n.observed, 0)
        x.append(n.features)
        y.append(label)
        chain.append(label[n.chain])
        ends = n.observed[n.skip] >= 0
        skip.append(label[n.skip[ends[:, 0] == ends[:, 1]]])  # a mention that base patterns miss is no evidence against its hub
    features, labels = np.concatenate(x), np.concatenate(y)
    w = np.zeros((N_FEATURES, LABELS))
    if len(labels):
        target = np.eye(LABELS)[labels]
        for _ in range(steps):
            z = features @ w
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            w -= rate * (features.T @ (p - target) / len(labels) + l2 * w)
    same = np.full((LABELS, LABELS), -2.0) + 6.0 * np.eye(LABELS)  # prior of skip factors: similar tokens agree
    return Weights(w, _pmi(np.concatenate(chain)), same + 0.5 * _pmi(np.concatenate(skip)))


def marginals(n: Nodes, w: Weights, tolerance: float = 1e-4) -> np.ndarray:
    """Loopy sum-product over chain and skip factors until messages settle; observed nodes are fixed.

    Messages that cycle end after four rounds a node (1,000 at least), more than any path is long."""
    unary = n.features @ w.node
    seen = np.flatnonzero(n.observed >= 0)
    unary[seen] = -30.0
    unary[seen, n.observed[seen]] = 0.0
    edges = np.concatenate((n.chain, n.skip))
    if len(edges):
        factor = np.concatenate((np.repeat(w.chain[None], len(n.chain), 0), np.repeat(w.skip[None], len(n.skip), 0)))
        src = np.concatenate((edges[:, 0], edges[:, 1]))
        dst = np.concatenate((edges[:, 1], edges[:, 0]))
        factor = np.concatenate((factor, factor.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        # Observed nodes take no messages: those of many mentions would outweigh the observation.
        fixed = np.flatnonzero(n.observed[dst] >= 0)
        msg = np.zeros((len(src), LABELS))
        for _ in range(max(1000, 4 * len(unary))):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = (belief[src] - msg[back])[:, :, None] + factor
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            new[fixed] = 0.0
            change = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if change <= tolerance:
                break
        np.add.at(unary, dst, msg)
    unary -= unary.max(1, keepdims=True)
    p = np.exp(unary)
    return p / p.sum(1, keepdims=True)


def _shaped(kind: int, text: str) -> bool:
    digits = sum(c.isdigit() for c in text)
    if kind == 0:
        return "@" in text and "." in text
    if kind == 1:
        return text.count(".") == 3 and 4 <= digits <= 12
    return 12 <= digits <= 19 if kind == 2 else 7 <= digits <= 15 and not any(c.isalpha() for c in text)


def inferred_spans(text: str, base: list[tuple[int, int, int]], w: Weights, threshold: float) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field labels and the base patterns left out; neighbours of one kind merge."""
    n = nodes_of(text, base)
    hidden = np.flatnonzero(n.observed < 0)
    if not len(hidden):
        return []
    p = marginals(n, w)
    label = np.where(n.observed >= 0, n.observed, np.where(p.max(1) >= threshold, p.argmax(1), 0))
    agrees = np.zeros(len(label), bool)
    for a, b in n.skip.tolist():
        if label[a] == label[b] > 0:
            agrees[a] = agrees[b] = True
    joined = {b: a for a, b in n.chain.tolist()}
    out: list[tuple[int, int, int]] = []
    groups: list[list[int]] = []
    for i in hidden.tolist():
        if label[i] == 0:
            continue
        if groups and joined.get(i) == groups[-1][-1] and label[groups[-1][-1]] == label[i] and label[i] >= 3:
            groups[-1].append(i)
        else:
            groups.append([i])
    for g in groups:
        raw = text[n.spans[g[0]][0] : n.spans[g[-1]][1]]
        kind = int(label[g[0]]) - 1
        if not (_shaped(kind, raw) or any(agrees[i] for i in g)):
            continue
        lead = len(raw) - len(raw.lstrip(".,;:\"'<>[]"))
        tail = len(raw.rstrip(".,;:\"'<>[]"))
        if lead < tail:
            out.append((n.spans[g[0]][0] + lead, kind, n.spans[g[0]][0] + tail))
    return out


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(w: Weights, threshold: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for ids, texts in slices(batches):
            counts, digests, spans = [[0] * len(ids) for _ in KINDS], [], []
            for i, raw in enumerate(texts):
                digits, at_sign = bool(raw and _DIGIT.search(raw)), bool(raw and b"@" in raw)
                if not (digits or at_sign):
                    digests.append(nothing)
                    spans.append("")
                    continue
                text = raw.decode()
                base = base_spans(text, digits, at_sign)
                for _, k, _ in base:
                    counts[k][i] += 1
                digests.append(hashlib.sha256(span_text(base).encode()).hexdigest())
                spans.append(span_text(base + inferred_spans(text, base, w, threshold)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(spans, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    return go


def find_pii(docs: DataFrame, sample_rows: int = 600, sample_chars: int = 20_000, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    scale = 1 << 40  # about ten times as many rows are drawn as are wanted, whatever the table's size
    drawn = min(scale, 10 * sample_rows * scale // max(1, docs.count()))
    h = F.pmod(F.xxhash64(F.lit("pii"), "i"), F.lit(scale))
    # Of a longer text, a window at a place by hash anywhere in it.
    place = F.pmod(F.xxhash64(F.lit("place"), "i"), F.greatest(F.lit(1), F.length("t") - sample_chars + 1)).cast("int")
    windows = rows.filter(h < drawn).select("i", F.substr("t", place + 1, F.lit(sample_chars)).alias("t"))
    chosen = windows.filter(F.col("t").rlike("[0-9@]")).orderBy(h, "i", "t").limit(sample_rows)
    w = train([r["t"] for r in chosen.collect()])  # at most sample_rows x sample_chars
    return id_and_text(docs).mapInArrow(
        _scan(w, threshold),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )
