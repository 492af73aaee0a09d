"""Data model: enumerations with their order, table schemas, symbol ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGS = ("python", "rust", "typescript")
SYMBOL_KINDS = ("module", "class", "function", "method", "struct", "enum", "trait", "interface", "type_alias", "const", "variable")
EDGE_KINDS = ("calls", "imports", "inherits", "contains", "references", "tests")
PROVENANCES = ("extracted", "resolved", "inferred", "name_guess")
CONFIDENCES = ("extracted", "inferred", "ambiguous")
#: Edges that mean "src depends on dst".
DEPENDENCY_KINDS = tuple(k for k in EDGE_KINDS if k != "contains")
EXTERNAL = "<external>:"
MODULE, WILDCARD, DYNAMIC = "<module>", "*", "<dynamic>"
SELF_RECEIVERS = ("self", "cls", "super()")
SEPARATORS = {"python": ".", "rust": "::", "typescript": "."}

SYMBOL = (
    "id string, path string, lang string, name string, qualified string, kind string, start_line int, end_line int, "
    "start_byte int, end_byte int, exported boolean, signature string, parent string, is_test boolean"
)
RAW_EDGE = (
    "path string, idx int, lang string, src string, kind string, site_line int, dst_id string, name string, key_name string, "
    "qualifier string, import_path string, prov string"
)
FILE = "path string, lang string, content_hash string, parse_ok boolean"
LINK = "path string, idx int, src string, dst string, kind string, prov string, site_line int"
RESOLUTION = (
    "path string, idx int, src string, kind string, site_line int, outcome string, dst string, provenance string, candidates int"
)
HUNK = "path string, start_line int, line_count int"


def ordinal(c: Column, values: tuple[str, ...]) -> Column:
    """Position of a value in its enumeration."""
    out = F.when(c == values[0], F.lit(0))
    for i, v in enumerate(values[1:], 1):
        out = out.when(c == v, F.lit(i))
    return out


def from_ordinal(c: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), c)


def confidence(prov: Column) -> Column:
    """0 extracted, 1 inferred, 2 ambiguous: smaller is stronger."""
    return F.when(prov.isin("extracted", "resolved"), 0).when(prov == "inferred", 1).otherwise(2)


def trusted(prov: Column) -> Column:
    return prov.isin("extracted", "resolved")


# --- BLAKE3 of at most one chunk (1,024 bytes), enough for symbol ids and, chunk by chunk, for files ---
# Initial state, message schedule and flags of the published hash.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTE = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF


def _compress(cv, block: bytes, counter: int, flags: int) -> list[int]:
    m = [int.from_bytes(block[i : i + 4].ljust(4, b"\0"), "little") for i in range(0, 64, 4)]
    s = [*cv, *_IV[:4], counter & _MASK, counter >> 32, len(block), flags]

    def g(a, b, c, d, x, y):
        s[a] = (s[a] + s[b] + x) & _MASK
        s[d] = ((s[d] ^ s[a]) >> 16 | (s[d] ^ s[a]) << 16) & _MASK
        s[c] = (s[c] + s[d]) & _MASK
        s[b] = ((s[b] ^ s[c]) >> 12 | (s[b] ^ s[c]) << 20) & _MASK
        s[a] = (s[a] + s[b] + y) & _MASK
        s[d] = ((s[d] ^ s[a]) >> 8 | (s[d] ^ s[a]) << 24) & _MASK
        s[c] = (s[c] + s[d]) & _MASK
        s[b] = ((s[b] ^ s[c]) >> 7 | (s[b] ^ s[c]) << 25) & _MASK

    for _ in range(7):
        for k in range(4):
            g(k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            g(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        m = [m[i] for i in _PERMUTE]
    return [s[i] ^ s[i + 8] for i in range(8)]


def _chunk(data: bytes, counter: int, root: bool) -> list[int]:
    cv = list(_IV)
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, b in enumerate(blocks):
        last = i == len(blocks) - 1
        flags = (_CHUNK_START if i == 0 else 0) | (_CHUNK_END if last else 0) | (_ROOT if last and root else 0)
        cv = _compress(cv, b, counter, flags)
    return cv


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 digest."""
    chunks = [data[i : i + 1024] for i in range(0, len(data), 1024)] or [b""]
    raw = lambda cv: b"".join(x.to_bytes(4, "little") for x in cv)
    if len(chunks) == 1:
        return raw(_chunk(chunks[0], 0, True))

    def tree(lo: int, hi: int, root: bool) -> list[int]:
        if hi - lo == 1:
            return _chunk(chunks[lo], lo, False)
        left = 1 << ((hi - lo - 1).bit_length() - 1)
        both = raw(tree(lo, lo + left, False)) + raw(tree(lo + left, hi, False))
        return _compress(_IV, both, 0, _PARENT | (_ROOT if root else 0))

    return raw(tree(0, len(chunks), True))


def symbol_id(lang: str, path: str, qualified: str, kind: str, overload: int = 0) -> str:
    """32 hex digits; never depends on a line."""
    raw = "\0".join((lang, path, qualified, kind)).encode() + b"\0" + overload.to_bytes(4, "little")
    return blake3(raw)[:16].hex()
