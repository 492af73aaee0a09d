"""Shell commands to search plans: what a pipeline around a text search means.

Commands are split into segments and stages.  Anything not modelled (subshells, input redirection,
background jobs, other redirections) gives None, and the caller leaves the command alone.
"""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field

from ..operators.search import SearchSpec

_TRANSFORMS = ("wc", "sort", "uniq", "cut", "awk", "sed", "tr", "xargs", "tail", "column", "nl", "rev", "paste", "jq")
_TESTISH = ("test", "tests", "/tests/", "tests/", "/test/", "test/", "_test", "test_", "/tests", "/test")
_SEARCH_TOOLS = ("grep", "egrep", "fgrep", "rg", "ag", "ack")
# File types and their globs.
TYPES = {
    "py": ["*.py", "*.pyi"], "python": ["*.py", "*.pyi"], "rust": ["*.rs"], "rs": ["*.rs"], "js": ["*.js", "*.jsx", "*.mjs", "*.cjs"],
    "ts": ["*.ts", "*.tsx"], "md": ["*.md"], "markdown": ["*.md"], "toml": ["*.toml"], "yaml": ["*.yml", "*.yaml"], "json": ["*.json"],
    "go": ["*.go"], "sh": ["*.sh", "*.bash", "*.zsh"],
}


@dataclass
class Segment:
    """A pipeline: its stages, how it follows the one before (None, ``&&``, ``||``, ``;``), whether its output
    goes nowhere, and a variable it is assigned to."""

    stages: list[str]
    join: str | None = None
    discard: bool = False
    assign: str | None = None


# One token of a command outside of words: order matters.
_TOKEN = re.compile(
    r"""(?P<word>(?:'[^']*'|"(?:\\.|[^"\\])*"|\\.|[^\s'"\;&|<>()`$]|\$(?!\())+)
      |(?P<err>(?<=\s)2>\s*/dev/null\b|(?<=\s)2>&1)|(?P<null>&>\s*/dev/null\b|1?>>?\s*/dev/null\b)
      |(?P<op>&&|\|\||;|\n|\|)|(?P<space>[ \t\r]+)|(?P<bad>.)""",
    re.X | re.S,
)


def split(command: str) -> list[Segment] | None:
    """Segments of a command, or None if it uses what isn't modelled."""
    m = re.match(r"\s*([A-Za-z_]\w*)=\"?\$\((.*)\)\"?\s*((?:;|&&|\n).*)?\Z", command, re.S)
    if m:
        inner, rest = split(m[2]), split(m[3].lstrip("; &\n")) if m[3] else []
        if inner is None or rest is None or len(inner) != 1:
            return None
        if rest:
            rest[0].join = "&&" if m[3].lstrip().startswith("&&") else ";"
        return [Segment(inner[0].stages, None, inner[0].discard, m[1]), *rest]
    out: list[Segment] = []
    stages: list[str] = []
    text, join, discard = "", None, False

    def stage() -> bool:
        nonlocal text
        done = bool(text.strip())
        if done:
            stages.append(text.strip())
        text = ""
        return done

    def segment(next_join: str | None) -> bool:
        nonlocal stages, join, discard
        ok = stage()
        if ok:
            out.append(Segment(stages, join if out else None, discard))
            stages, discard = [], False
            join = next_join
        return ok or not stages

    # Redirections are recognised only where a word could begin; digits before ">" belong to them.
    at = 0
    while at < len(command):
        redirect = re.compile(r"2>\s*/dev/null\b|2>&1").match(command, at) if not text or text[-1] in " \t" else None
        if redirect:
            at = redirect.end()
            continue
        null = re.compile(r"(?:&>|1?>>?)\s*/dev/null\b").match(command, at)
        if null and (null[0][0] != "1" or not text or text[-1] in " \t"):
            discard, at = True, null.end()
            continue
        t = _TOKEN.match(command, at)
        if t is None or t.lastgroup == "bad":
            return None
        kind, body = t.lastgroup, t[0]
        if kind == "word":
            if "`" in re.sub(r"'[^']*'", "", body) or re.search(r'"[^"]*\$\(', body):
                return None
            piece = re.search(r"(?<=\s)\d+\Z", body)
            text += body if not piece else body
        elif kind == "space":
            text += body
        elif body == "|":
            if not stage():
                return None
        elif body in ("&&", "||"):
            if not text.strip() or not segment(body):
                return None
        elif not segment(";"):
            return None
        at = t.end()
    if text.strip():
        segment(None)
    elif stages or join in ("&&", "||"):
        return None
    return out


def words(stage: str) -> list[str] | None:
    try:
        return shlex.split(stage)
    except ValueError:
        return None


def quote(word: str) -> str:
    return word if re.fullmatch(r"[A-Za-z0-9_./=:,@%+-]+", word) else "'" + word.replace("'", "'\\''") + "'"


_VARIABLE = re.compile(r"""'[^']*'|\\.|(")|\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))""")


def expand(text: str, env: dict[str, str]) -> str:
    """``text`` with the variables of ``env``: unquoted ones as quoted words, those in double quotes as they are."""
    quoted = False

    def put(m: re.Match) -> str:
        nonlocal quoted
        if m[1]:
            quoted = not quoted
        name = m[2] or m[3]
        if name not in env:
            return m[0]
        value = env[name]
        return re.sub(r'(["\\$`])', r"\\\1", value) if quoted else " ".join(map(quote, value.split()))

    # A single quote inside double quotes is an ordinary character.
    if '"' in text and "'" in text:
        out, at = "", 0
        for part in re.finditer(r'"(?:\\.|[^"\\])*"|\'[^\']*\'|[^"\']+', text):
            s = part[0]
            if s[0] == "'":
                out += s
            else:
                quoted = s[0] == '"'
                inner = s[1:-1] if quoted else s
                put_ = _VARIABLE.sub(lambda m: put(m) if not m[1] else m[0], inner)
                out += f'"{put_}"' if quoted else put_
            at = part.end()
        return out + text[at:]
    return _VARIABLE.sub(put, text)


def references(text: str, env: dict[str, str]) -> list[str]:
    bare = re.sub(r"'[^']*'", "", text)
    found = [a or b for a, b in re.findall(r"(?<!\\)\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))", bare)]
    return list(dict.fromkeys(n for n in found if n in env))


def env_prefix(env: dict[str, str]) -> str:
    return "".join(f"{k}={quote(v)}; " for k, v in sorted(env.items()))


def basic_to_extended(pattern: str) -> str:
    """A basic regular expression as an extended one: bare operators are literal, escaped ones operate."""

    def put(m: re.Match) -> str:
        s = m[0]
        if s == "\\":
            return "\\\\"
        if s[0] == "\\":
            return s[1] if s[1] in "|(){}+?" else s
        return "\\" + s

    return re.sub(r"\\.|\\\Z|[|(){}+?]", put, pattern, flags=re.S)


@dataclass
class Stage:
    """What a stage after a search does: noop, budget (lines or bytes), line (a filter), drop_tests, transform
    (needs the plain output) or real (anything else)."""

    kind: str
    lines: int | None = None
    bytes: int | None = None
    pattern: str | None = None
    fixed: bool = False
    word: bool = False
    ignore_case: bool = False
    invert: bool = False
    source: str = ""


def _budget(w: list[str]) -> Stage:
    if len(w) == 1:
        return Stage("budget", lines=10, source=" ".join(w))
    m = re.fullmatch(r"(?:(-c|--bytes)|(-n|--lines)|(-))[= ]?(\d+)", " ".join(w[1:]))
    if not m or int(m[4]) == 0:
        return Stage("real")
    return Stage("budget", bytes=int(m[4]) if m[1] else None, lines=None if m[1] else int(m[4]), source=" ".join(w))


def _grep(w: list[str], source: str) -> Stage:
    out = Stage("line", fixed=w[0] == "fgrep", source=source.strip())
    extended = w[0] != "grep"
    rest = w[1:]
    while rest:
        a = rest.pop(0)
        if a == "-e" and rest:
            out.pattern = rest.pop(0)
        elif re.fullmatch(r"-[viEFw]+", a):
            out.invert |= "v" in a
            out.ignore_case |= "i" in a
            out.fixed |= "F" in a
            out.word |= "w" in a
            extended |= "E" in a
        elif a.startswith("-") or out.pattern is not None:
            return Stage("real")
        else:
            out.pattern = a
    if out.pattern is None:
        return Stage("real")
    if w[0] == "grep" and not extended and not out.fixed:
        out.pattern = basic_to_extended(out.pattern)
    if out.invert and out.pattern.strip("'").lower() in _TESTISH:
        return Stage("drop_tests", source=out.source)
    return out


def stage(text: str) -> Stage:
    """The meaning of a stage that reads a search's output."""
    w = words(text)
    if not w:
        return Stage("real")
    if w[0] == "head":
        return _budget(w)
    if w[0] == "cat" and len(w) == 1:
        return Stage("noop")
    if w[0] in ("grep", "egrep", "fgrep", "rg"):
        return _grep(w, text)
    return Stage("transform" if w[0] in _TRANSFORMS else "real")


_LONG_VALUE = {"include": "glob", "glob": "glob", "iglob": "glob", "exclude": "not", "exclude-dir": "not", "type": "type", "regexp": "e",
               "after-context": "A", "before-context": "B", "context": "C"}
_LONG_FLAG = {"recursive": "r", "dereference-recursive": "r", "with-filename": "H", "no-filename": "h", "ignore-case": "i", "smart-case": "S", "word-regexp": "w",
              "fixed-strings": "F", "literal": "F", "extended-regexp": "E", "files-with-matches": "l", "no-ignore": "u", "unrestricted": "u", "hidden": ".",
              "line-number": "", "no-heading": "", "heading": "", "no-messages": "", "color": "", "colour": "", "case-sensitive": ""}


def search_spec(w: list[str], label: str = "") -> SearchSpec | None:
    """grep, rg, ag or ack words as a search; None for flags whose output isn't reproduced, or a search of standard input."""
    if not w or w[0] not in _SEARCH_TOOLS:
        return None
    grep = w[0] in ("grep", "egrep", "fgrep")
    spec = SearchSpec(fixed=w[0] == "fgrep", label=label or " ".join(w))
    flags: set[str] = set()
    rest, operands = list(w[1:]), []

    def value(flag: str, v: str) -> bool:
        if flag == "e":
            spec.patterns.append(v)
        elif flag == "glob":
            spec.globs.append(v)
        elif flag == "not":
            spec.globs.append(f"!{v}")
        elif flag == "type":
            if v not in TYPES:
                return False
            spec.globs.extend(TYPES[v])
        elif not v.isdigit():
            return False
        else:
            spec.before = int(v) if flag in "BC" else spec.before
            spec.after = int(v) if flag in "AC" else spec.after
        return True

    while rest:
        a = rest.pop(0)
        if a == "--":
            operands += rest
            break
        if a == "-":
            return None
        if a.startswith("--"):
            k, eq, v = a[2:].partition("=")
            if k in _LONG_VALUE:
                if not eq and not rest:
                    return None
                if not value(_LONG_VALUE[k], v if eq else rest.pop(0)):
                    return None
            elif k in _LONG_FLAG and not (k == "hidden" and grep):
                flags.update(_LONG_FLAG[k])
            else:
                return None
        elif a.startswith("-"):
            body = a[1:]
            if grep and body.isdigit():
                value("C", body)
                continue
            while body:
                f, body = body[0], body[1:]
                if f in "eABC" or f in "gt" and not grep:
                    v = body or (rest.pop(0) if rest else "")
                    if not v or not value({"g": "glob", "t": "type"}.get(f, f), v):
                        return None
                    break
                if f in "Su." and grep or f in "rR" and not grep or f not in "rRHhnsIiSwFQElu.":
                    return None
                flags.update({"R": "r", "Q": "F", "n": "", "s": "", "I": ""}.get(f, f))
        else:
            operands.append(a)
    if not spec.patterns:
        if not operands:
            return None
        spec.patterns.append(operands.pop(0))
    spec.ignore_case, spec.smart_case, spec.word = "i" in flags, "S" in flags, "w" in flags
    spec.fixed |= "F" in flags
    spec.files_only, spec.no_ignore, spec.hidden = "l" in flags, "u" in flags, "." in flags
    recursive = "r" in flags or not grep
    if w[0] == "grep" and "E" not in flags and not spec.fixed:
        spec.patterns = [basic_to_extended(p) for p in spec.patterns]
    if not operands and not recursive:
        return None
    spec.paths = [p.rstrip("/") for p in operands if p not in (".", "./")]
    one = len(operands) == 1 and not re.search(r"[*?\[]", operands[0]) and "." in operands[0].rsplit("/", 1)[-1]
    spec.no_filename = "h" in flags or ("H" not in flags and one and not (grep and recursive))
    return spec


@dataclass
class Plan:
    """A search with the meaning of the stages behind it."""

    spec: SearchSpec
    stages: list[Stage] = field(default_factory=list)


def plan(command: str) -> list[tuple[Segment, Plan | None]] | None:
    """Each segment with its search plan; None in place of a plan for a segment to be run as it is."""
    segments = split(command)
    if segments is None:
        return None
    out = []
    for s in segments:
        w = words(s.stages[0])
        spec = search_spec(w, s.stages[0]) if w else None
        stages = [stage(x) for x in s.stages[1:]]
        fine = spec is not None and all(x.kind in ("noop", "budget", "line", "drop_tests") for x in stages)
        out.append((s, Plan(spec, stages) if fine else None))
    return out


_READ_ONLY = set("ls cat head tail wc sort uniq cut tr grep egrep fgrep rg ag ack find pwd echo printf stat file du diff cmp nl tree which true false basename dirname test cd".split())
_GIT_READ_ONLY = set("log show diff status blame grep ls-files rev-parse branch describe cat-file shortlog".split())


def read_only(command: str) -> bool:
    """Whether a command surely changes nothing."""
    segments = split(command)
    if not segments:
        return False
    for s in segments:
        for text in s.stages:
            w = words(text)
            if not w:
                return False
            if w[0] == "git":
                if len(w) < 2 or w[1] not in _GIT_READ_ONLY:
                    return False
            elif w[0] == "sed":
                if not sed_prints_only(w):
                    return False
            elif w[0] == "find":
                if any(x in ("-delete", "-exec", "-execdir", "-ok", "-fprint") for x in w):
                    return False
            elif w[0] not in _READ_ONLY:
                return False
    return True


def sed_prints_only(w: list[str]) -> bool:
    """``sed -n`` with line ranges to print, and nothing else."""
    rest = [x for x in w[1:] if x not in ("-n", "--quiet", "-E", "-r")]
    return ("-n" in w or "--quiet" in w) and bool(rest) and bool(re.fullmatch(r"(\d+|\$)?(,(\d+|\$))?p(;(\d+|\$)?(,(\d+|\$))?p)*", rest[0])) and not any(x.startswith("-i") for x in rest)
