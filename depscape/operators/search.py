"""Text search over lines, and what the dependency graph says about each match."""

from __future__ import annotations

import io
import re
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import basename
from ..model import confidence
from ..sources.tree import file_suffix, has_secret_part, is_indexable, text_lines, under_noise

MATCH_LIMIT = 20_000
MAX_NAMES, MAX_NAME_SYMBOLS = 6, 200
CLASSES = (
    "definition", "reference", "import", "graph_gap", "code_untracked", "string_or_comment", "other_language", "not_indexed", "docs_config", "other_identifier",
)
# Extensions of code and of configuration.
CODE_EXTS = "rs ts tsx js jsx mjs cjs go java kt swift c h cc cpp hpp rb php sh bash zsh lua scala cs sql pyx pyi".split()
CONFIG_EXTS = "toml ini cfg conf yaml yml json jsonc properties env".split()


@dataclass
class SearchSpec:
    """A text search: patterns (any may match), how they are read, which files, and how results are shown."""

    patterns: list[str] = field(default_factory=list)
    fixed: bool = False
    word: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    unicode: bool = True
    globs: list[str] = field(default_factory=list)
    no_ignore: bool = False
    hidden: bool = False
    files_only: bool = False
    before: int = 0
    after: int = 0
    no_filename: bool = False
    paths: list[str] = field(default_factory=list)
    label: str = ""

    def regex(self) -> str:
        """One Java regular expression for all patterns."""
        parts = [re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", p) if self.fixed else p for p in self.patterns]
        body = "|".join(f"(?:{p})" for p in parts)
        if self.word:
            body = rf"\b(?:{body})\b"
        upper = any(c.isupper() for p in self.patterns for c in re.sub(r"\\.", "", p))
        flags = ("i" if self.ignore_case or self.smart_case and not upper else "") + ("U" if self.unicode else "")
        if "i" in flags and self.unicode:
            flags += "u"
        return f"(?{flags}){body}" if flags else body


def glob_regex(glob: str) -> str:
    """A glob as a regular expression on relative paths; without a slash it is for any name on the path."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            out += ".*" if glob.startswith("**", i) else "[^/]*"
            i += glob.startswith("**", i)
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : end].split(","))) + ")", end
        else:
            out += re.escape(c)
        i += 1
    return ("^" if "/" in glob else "(?:^|/)") + out.lstrip("/") + "(?:/|$)"


def accepted(spec: SearchSpec, path: Column) -> Column:
    """Files a search opens: no noise, no hidden ones unless asked, no secrets, and the globs' word."""
    keep = ~has_secret_part(path)
    if not spec.no_ignore:
        keep = keep & ~under_noise(path)
    if not spec.hidden:
        keep = keep & ~path.rlike(r"(^|/)\.[^/.]")
    wanted = [g for g in spec.globs if not g.startswith("!")]
    if wanted:
        some = F.lit(False)
        for g in wanted:
            some = some | path.rlike(glob_regex(g))
        keep = keep & some
    for g in spec.globs:
        if g.startswith("!"):
            keep = keep & ~path.rlike(glob_regex(g[1:]))
    if spec.paths:
        inside = F.lit(False)
        for p in spec.paths:
            inside = inside | (path == p) | F.startswith(path, F.lit(p.rstrip("/") + "/"))
        keep = keep & inside
    return keep


def secrets_skipped(spec: SearchSpec, files: DataFrame) -> DataFrame:
    """One row: how many files were left unread because they may hold secrets."""
    noise = F.lit(False) if spec.no_ignore else under_noise(F.col("path"))
    return files.filter(~noise & has_secret_part(F.col("path"))).agg(F.count("*").alias("n"))


def matches(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """path, line, col (byte of the first match, from 0), text: every matching line, in no order.

    ``files``: (path, text)."""
    lines = text_lines(files.filter(accepted(spec, F.col("path"))).select("path", "text"))
    hits = lines.filter(F.col("text").rlike(spec.regex()))
    at = F.regexp_instr("text", F.lit(spec.regex()))
    return hits.select("path", "line", F.octet_length(F.substr("text", F.lit(1), at - 1)).alias("col"), "text")


def search(files: DataFrame, spec: SearchSpec, limit: int = MATCH_LIMIT) -> DataFrame:
    """The first ``limit`` matches (the feature's early stop) in order of path and line, with seq from 0."""
    hits = matches(files, spec).orderBy("path", "line").limit(limit)
    return hits.withColumn("seq", F.row_number().over(Window.orderBy("path", "line")) - 1).select("seq", "path", "line", "col", "text")


def context(files: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    """path, line, text, hit: the hits and the lines around them, each once."""
    near = hits.select("path", F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line"), F.col("line").alias("of"))
    near = near.groupBy("path", "line").agg(F.bool_or(F.col("line") == F.col("of")).alias("hit"))
    return text_lines(files.select("path", "text")).join(near, ["path", "line"])


def files_with_matches(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.count("*").alias("matches"), F.min("line").alias("first_line"))


def enclosing(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """points (path, line, ...) with ``id``: the smallest symbol around the line, others than modules first."""
    p = points.withColumn("_p", F.monotonically_increasing_id())
    s = symbols.select("path", "id", "start_line", "end_line", "kind")
    hit = p.join(s, "path").filter((F.col("start_line") <= F.col("line")) & (F.col("end_line") >= F.col("line")))
    best = F.min(F.struct((F.col("kind") == "module").alias("m"), (F.col("end_line") - F.col("start_line")).alias("span"), "id")).alias("b")
    return points.join(hit.groupBy("path", "line").agg(best).select("path", "line", F.col("b.id").alias("id")), ["path", "line"], "left")


# --- identifiers ---


def identifiers(spec: SearchSpec) -> list[tuple[str, str]] | None:
    r"""(name, dotted form) of each alternative, if every one is an identifier, dotted or between ``\b``; at most six."""
    out: list[tuple[str, str]] = []
    for p in spec.patterns:
        alts = [p] if spec.fixed else alternatives(p)
        if alts is None:
            return None
        for a in alts:
            core = a if spec.fixed else re.sub(r"\\b$", "", re.sub(r"^\\b", "", a)).replace("\\.", ".")
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*", core):
                return None
            if (found := (core.split(".")[-1], core)) not in out:
                out.append(found)
    return out if 0 < len(out) <= MAX_NAMES else None


def alternatives(pattern: str) -> list[str] | None:
    """Top-level alternatives; none if groups or classes are used."""
    bare = re.sub(r"\\.", "", pattern)
    if re.search(r"[()\[\]]", bare):
        return None
    return re.findall(r"((?:\\.|[^|\\])*)(?:\||$)", pattern)[: bare.count("|") + 1]


def token_at(text: Column, col: Column) -> Column:
    """The identifier around a byte column."""
    raw = F.encode(text, "UTF-8")
    left = F.regexp_extract(F.decode(F.substring(raw, F.lit(1), col), "UTF-8"), r"[A-Za-z0-9_]*\z", 0)
    right = F.regexp_extract(F.decode(F.substring(raw, col + 1, F.octet_length(text)), "UTF-8"), r"\A[A-Za-z0-9_]*", 0)
    return F.concat(left, right)


def is_definition_line(text: Column, name: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(?:async )?(?:def|class) ([A-Za-z0-9_]*)", 1) == name


def looks_like_mock(text: Column, name: Column) -> Column:
    quoted = F.contains(text, F.concat(F.lit("."), name, F.lit('"'))) | F.contains(text, F.concat(F.lit("."), name, F.lit("'")))
    return F.lower(text).rlike("patch|mock|setattr") | quoted


def non_code_class(path: Column) -> Column:
    """ci, config or docs, by where a file lives."""
    p = F.lower(path)
    ci = p.rlike(r"(^|/)\.github/workflows/|^\.circleci/|^\.buildkite/") | basename(p).isin(".gitlab-ci.yml", ".travis.yml", "azure-pipelines.yml", "jenkinsfile")
    return F.when(ci, F.lit("ci")).when(p.rlike(r"(^|/)\.[^/]") | file_suffix(p).isin(*CONFIG_EXTS), F.lit("config")).otherwise(F.lit("docs"))


def _string_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kinds = {tokenize.STRING, tokenize.COMMENT} | {getattr(tokenize, n) for n in ("FSTRING_START", "FSTRING_MIDDLE", "FSTRING_END") if hasattr(tokenize, n)}
    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["text"]):
            lines = (text or "").split("\n")
            width = lambda line, c: len(lines[line - 1][:c].encode()) if line <= len(lines) else 0
            try:
                for t in tokenize.generate_tokens(io.StringIO(text or "").readline):
                    if t.type in kinds:
                        (l0, c0), (l1, c1) = t.start, t.end
                        rows.append((path, l0, width(l0, c0), l1, width(l1, c1)))
            except (tokenize.TokenError, SyntaxError, IndentationError):
                pass
        yield pd.DataFrame(rows, columns=["path", "l0", "c0", "l1", "c1"])


def string_spans(files: DataFrame) -> DataFrame:
    """path, l0, c0, l1, c1: where strings and comments stand in Python files (lines from 1, byte columns)."""
    return files.select("path", "text").mapInPandas(_string_spans, "path string, l0 int, c0 int, l1 int, c1 int")


# --- judging ---


def name_facts(symbols: DataFrame, links: DataFrame, resolution: DataFrame, raw_edges: DataFrame, names: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the graph knows of names: (name, symbols), (name, path, line, kind, confidence, src, dst) of uses,
    (name, path, line, why) of references that bind to no single symbol."""
    spark = symbols.sparkSession
    asked = spark.createDataFrame(names, "name string, dotted string")  # at most MAX_NAMES
    s = symbols.join(F.broadcast(asked), "name").filter(~F.contains("dotted", F.lit(".")) | F.endswith("qualified", F.col("dotted")))
    w = Window.partitionBy("name").orderBy("id")
    s = s.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= MAX_NAME_SYMBOLS).drop("_n", "dotted")
    sites = links.filter("kind <> 'contains'").drop("path", "idx").join(s.select(F.col("id").alias("dst"), "name"), "dst")
    at = symbols.select(F.col("id").alias("src"), "path")
    best = F.max(F.struct("dst", "kind", confidence(F.col("prov")).alias("conf"), "src")).alias("b")
    refs = sites.join(at, "src").groupBy("name", "path", F.col("site_line").alias("line")).agg(best)
    refs = refs.select("name", "path", "line", "b.kind", F.col("b.conf").alias("confidence"), "b.src", "b.dst")
    internal = F.col("import_path").isNull() | ~F.startswith("import_path", F.lit("<external>:"))
    open_ = raw_edges.filter(internal).select("path", "idx", F.col("key_name").alias("name")).join(F.broadcast(asked.select("name")), "name")
    g = resolution.filter("outcome <> 'resolved'").join(open_, ["path", "idx"])
    why = F.when(F.col("outcome") == "ambiguous", F.concat(F.lit("ambiguous: "), F.col("candidates").cast("string"), F.lit(" candidates"))).otherwise(F.lit("unresolved"))
    return s, refs, g.groupBy("name", "path", F.col("site_line").alias("line")).agg(F.max(why).alias("why"))


def fact_for(names: list[tuple[str, str]], token: Column) -> Column:
    """Which name a match belongs to: the one its token is, else one it begins with, else the first."""
    exact = F.lit(None).cast("string")
    prefix = F.lit(None).cast("string")
    for n, _ in reversed(names):
        exact = F.when(token == n, F.lit(n)).otherwise(exact)
        prefix = F.when(F.startswith(token, F.lit(n)), F.lit(n)).otherwise(prefix)
    return F.coalesce(exact, prefix, F.lit(names[0][0]))


def import_block(hits: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """hits with in_import: whether the line continues an import statement whose parenthesis is open.

    The statement is the last import line of the file before the hit (an as-of join): one window over hits
    and import lines of a file."""
    rows = hits.select("path", "line", F.lit(None).cast("int").alias("start")).distinct()
    marks = imports.select("path", "line", F.col("line").alias("start")).distinct()
    w = Window.partitionBy("path").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    last = rows.unionByName(marks).withColumn("at", F.max("start").over(w)).filter("start is null and at is not null").select("path", "line", "at")
    texts = last.join(files.select("path", "text"), "path")
    block = F.array_join(F.slice(F.split("text", "\n"), F.col("at"), F.col("line") - F.col("at")), "\n")
    open_ = texts.select("path", "line", (F.contains(block, F.lit("(")) & ~F.contains(block, F.lit(")"))).alias("in_import"))
    return hits.join(open_, ["path", "line"], "left").withColumn("in_import", F.coalesce("in_import", F.lit(False)))


def judge(hits: DataFrame, files: DataFrame, symbols: DataFrame, links: DataFrame, resolution: DataFrame, raw_edges: DataFrame, names: list[tuple[str, str]] | None) -> DataFrame:
    """hits with ``name``, ``class`` and, for uses, kind, confidence, src, dst, why.

    Rules, first that holds: a use the graph has (import or reference); a line of an open import; the
    definition's line; a reference the graph couldn't bind; another identifier; then by the kind of file:
    other languages, documents and configuration, strings and comments, untracked code, unindexed files."""
    suffix = file_suffix("path")
    py = files.filter(F.endswith("path", F.lit(".py")))
    spans = string_spans(py)
    inside = (
        (F.struct("line", "col") >= F.struct(F.col("l0").alias("line"), F.col("c0").alias("col")))
        & (F.struct("line", "col") < F.struct(F.col("l1").alias("line"), F.col("c1").alias("col")))
    )
    quoted = hits.select("seq", "path", "line", "col").join(spans, "path").filter(inside).select("seq").distinct().withColumn("quoted", F.lit(True))
    by_place = (
        F.when(suffix != "py", F.when(suffix.isin(*CODE_EXTS), F.lit("other_language")).otherwise(F.lit("docs_config")))
        .when(~is_indexable("path"), F.lit("not_indexed"))
        .when(F.col("quoted"), F.lit("string_or_comment"))
        .otherwise(F.lit("code_untracked"))
    )
    h = hits.join(quoted, "seq", "left")
    if not names:
        null = F.lit(None)
        return h.select(
            *hits.columns, null.cast("string").alias("name"), by_place.alias("class"), null.cast("string").alias("kind"), null.cast("int").alias("confidence"),
            null.cast("string").alias("src"), null.cast("string").alias("dst"), null.cast("string").alias("why"),
        )
    syms, refs, gaps = name_facts(symbols, links, resolution, raw_edges, names)
    h = h.withColumn("token", token_at(F.col("text"), F.col("col"))).withColumn("name", fact_for(names, F.col("token")))
    h = h.join(refs, ["name", "path", "line"], "left").join(gaps, ["name", "path", "line"], "left")
    h = import_block(h, refs.filter("kind = 'imports'"), py)
    h = h.join(syms.select("name", "path").distinct().withColumn("defined", F.lit(True)), ["name", "path"], "left")
    indexed = is_indexable("path")
    cls = (
        F.when(F.col("kind") == "imports", F.lit("import"))
        .when(F.col("kind").isNotNull(), F.lit("reference"))
        .when(indexed & F.col("in_import"), F.lit("import"))
        .when(F.col("defined") & is_definition_line(F.col("text"), F.col("name")), F.lit("definition"))
        .when(F.col("why").isNotNull(), F.lit("graph_gap"))
        .when(F.col("token") != F.col("name"), F.lit("other_identifier"))
        .otherwise(by_place)
    )
    return h.withColumn("class", cls).select(*hits.columns, "name", "class", "kind", "confidence", "src", "dst", "why")


def graph_only(hits: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """Uses the graph has in searched files, on lines the text search didn't match."""
    return refs.join(hits.select("path", "line"), ["path", "line"], "left_anti").join(files.select("path").distinct(), "path", "left_semi")


def class_histogram(judged: DataFrame) -> DataFrame:
    return judged.groupBy("class").agg(F.count("*").alias("n"))


def verdict(judged: DataFrame) -> DataFrame:
    """One row: none, complete, or lower_bound where gaps or untracked code could hide uses."""
    n = F.count("*")
    unsure = F.count_if(F.col("class").isin("graph_gap", "code_untracked", "not_indexed"))
    tracked = F.count_if(F.col("class").isin("definition", "reference", "import"))
    word = F.when(tracked == 0, F.lit("none")).when(unsure > 0, F.lit("lower_bound")).otherwise(F.lit("complete"))
    return judged.agg(word.alias("verdict"), n.alias("matches"), unsure.alias("unsure"))


def line_filter(items: DataFrame, pattern: str, fixed: bool = False, word: bool = False, ignore_case: bool = False, invert: bool = False, rendered: str = "rendered") -> DataFrame:
    spec = SearchSpec([pattern], fixed=fixed, word=word, ignore_case=ignore_case)
    hit = F.col(rendered).rlike(spec.regex())
    return items.filter(~hit if invert else hit)


def plain_output(hits: DataFrame, before: int = 0, after: int = 0, names: bool = True) -> DataFrame:
    """One row: lines and bytes that the plain command prints, context and separators included."""
    shown = hits.select("path", F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line")).filter("line > 0").distinct()
    w = Window.partitionBy("path").orderBy("line")
    gaps = shown.withColumn("gap", (F.col("line") - F.coalesce(F.lag("line").over(w), F.lit(-1))) > 1)
    extra = F.count_if("gap") - 1 if before or after else F.lit(0)
    lines = gaps.agg((F.count("*") + F.greatest(extra, F.lit(0))).alias("lines"))
    prefix = F.octet_length("path") + 1 if names else F.lit(0)
    size = hits.agg(F.coalesce(F.sum(F.octet_length("text") + 1 + prefix), F.lit(0)).alias("bytes"))
    return lines.crossJoin(size)  # one row each
