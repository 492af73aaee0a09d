r"""Secret scan with multipart credential linking.

Certain secrets are found by three base patterns.  Weak candidates (things that look like an access
identifier, a secret or an endpoint, but also like much else) count only in company: identifiers,
secrets and endpoints are joined as intervals within a scope, and a weak candidate is reported when
its scope holds a complementary part.  A scope is a paragraph (text between blank lines) cut to
``reach`` code points on either side of a part.

Linking rules: a weak identifier needs a secret; a weak secret needs an identifier; an endpoint needs
an identifier and a secret.  Base findings are never removed or moved, and added spans don't overlap them.

Defined results: null or empty text has no findings; rows with equal ids, or without one, keep their own row; spans of
equal place and kind can't repeat, and those of equal start come in the kinds' order by name of their numbers; whole
texts are scanned whatever their length; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, id_and_text, slices

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
# The base patterns.
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
# Weak candidates.
# Any length, and after any character that can't be part of them: an equals sign
# (name=value) too, and a slash or hyphen before an identifier; a secret may hold those itself.
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+_])(?=[A-Z]*+[0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9+/_=-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}")
_MAYBE_IDENTIFIER = re.compile(rb"[A-Z0-9]{16}")
_GAP = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match."""
    out = []
    low = raw.translate(LOWER)
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _looks_secret(s: str) -> bool:
    kinds = (any(c.islower() for c in s), any(c.isupper() for c in s), any(c.isdigit() for c in s))
    return sum(kinds) == 3 and _entropy(s) >= 3.5


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    """Weak candidates whose scope holds a complementary part."""
    starts: list[int] = []  # base spans, those that overlap as one
    stops: list[int] = []
    for s, e in sorted((s, e) for s, _, e in base):
        if stops and s < stops[-1]:
            stops[-1] = max(stops[-1], e)
        else:
            starts.append(s)
            stops.append(e)

    def free(s: int, e: int) -> bool:
        k = bisect.bisect_left(starts, e)
        return k == 0 or stops[k - 1] <= s

    ids = [(s, e) for s, k, e in base if k == 1]
    secrets = [(s, e) for s, k, e in base if k != 1]
    weak_ids = [m.span() for m in _IDENTIFIER.finditer(text) if free(*m.span())]
    weak_secrets = [m.span() for m in _SECRET.finditer(text) if free(*m.span()) and _looks_secret(m[0])]
    ends = [m.span() for m in _ENDPOINT.finditer(text) if free(*m.span())]
    if not (weak_ids or weak_secrets or ends):
        return []
    ends_of = lambda parts: (sorted(s for s, _ in parts), sorted(e for _, e in parts))
    all_ids, all_secrets = ends_of(ids + weak_ids), ends_of(secrets + weak_secrets)
    cuts = [m.start() for m in _GAP.finditer(text)]

    def near(part: tuple[int, int], others: tuple[list[int], list[int]]) -> bool:
        """Whether another part's interval, wholly before or after this part, meets its scope."""
        k = bisect.bisect_left(cuts, part[0])
        low = max(part[0] - reach, cuts[k - 1] if k else 0)
        high = min(part[1] + reach, cuts[k] if k < len(cuts) else len(text))
        first, last = others
        before, after = bisect.bisect_right(last, low), bisect.bisect_left(first, part[1])
        return before < len(last) and last[before] <= part[0] or after < len(first) and first[after] < high

    out = [(s, 3, e) for s, e in weak_ids if near((s, e), all_secrets)]
    out += [(s, 4, e) for s, e in weak_secrets if near((s, e), all_ids)]
    out += [(s, 5, e) for s, e in ends if near((s, e), all_ids) and near((s, e), all_secrets)]
    return out


def span_text(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(reach: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            counts, digests, spans = [[0] * len(ids) for _ in range(3)], [], []
            for i, raw in enumerate(texts):
                text = raw.decode() if raw else ""
                base = base_spans(text, raw or b"")
                for _, k, _ in base:
                    counts[k][i] += 1
                # Every rule needs an identifier, and both kinds of identifier hold such a run.
                weak = linked_spans(text, base, reach) if raw and _MAYBE_IDENTIFIER.search(raw) else []
                digests.append(hashlib.sha256(span_text(base, KINDS).encode()).hexdigest())
                spans.append(span_text(base + weak, KINDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return go


def scan_secrets(docs: DataFrame, reach: int = 400) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``."""
    return id_and_text(docs).mapInArrow(
        _scan(reach), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
