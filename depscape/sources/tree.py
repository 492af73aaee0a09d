"""Source trees, text files and record files as DataFrames."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import basename
from ..operators.iterate import Steps, dense_number

# Directories never indexed, and never searched.
EXCLUDED_DIRS = (
    ".git .venv venv env node_modules __pycache__ target dist build site-packages .mypy_cache .pytest_cache .tox .ruff_cache .DS_Store"
).split()
NOISE_DIRS = ".git .venv venv node_modules site-packages __pycache__ .mypy_cache .pytest_cache .tox .ruff_cache target dist build".split()
# Names that may hold secrets.
_SECRET = r"^\.env$|^\.env\.|^\.envs$|^\.netrc$|^id_rsa|^id_ed25519|^credentials|^secrets|\.(pem|key|p12|pfx)$"


def is_secret_name(name: Column | str) -> Column:
    return F.lower(F.col(name) if isinstance(name, str) else name).rlike(_SECRET)


def has_secret_part(path: Column | str) -> Column:
    """Whether a file or any directory on its path may hold secrets."""
    p = F.col(path) if isinstance(path, str) else path
    return F.exists(F.split(p, "/"), is_secret_name)


def under_noise(path: Column | str) -> Column:
    """Whether a path lies in a directory of dependencies, caches, output or another checkout's worktrees."""
    p = F.col(path) if isinstance(path, str) else path
    dirs = F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    return F.exists(dirs, lambda d: d.isin(*NOISE_DIRS)) | p.rlike(r"(^|/)\.claude/worktrees/")


def is_indexable(path: Column | str) -> Column:
    """Python files outside hidden and excluded directories."""
    p = F.col(path) if isinstance(path, str) else path
    dirs = F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    return F.endswith(p, F.lit(".py")) & ~F.exists(dirs, lambda d: F.startswith(d, F.lit(".")) | d.isin(*EXCLUDED_DIRS))


def gitignore_pattern(lines: list[str]) -> list[tuple[str, bool]]:
    """(regular expression, keep) for each rule of a .gitignore, in order; the last that matches decides."""
    out = []
    for line in lines:
        rule = line.rstrip("\n").strip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule.lstrip("!")
        rooted = "/" in rule.rstrip("/")
        only_dir = rule.endswith("/")
        body = rule.strip("/")
        text = ""
        i = 0
        while i < len(body):
            if body.startswith("**/", i):
                text, i = text + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                text, i = text + ".*", i + 2
            elif body[i] == "*":
                text, i = text + "[^/]*", i + 1
            elif body[i] == "?":
                text, i = text + "[^/]", i + 1
            else:
                text, i = text + re.escape(body[i]), i + 1
        out.append((("^" if rooted else "(?:^|/)") + text + ("/" if only_dir else "(?:/|$)"), keep))
    return out


def gitignored(path: Column | str, rules: list[tuple[str, bool]]) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for pattern, keep in rules:
        out = F.when(p.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


_LISTED = "path string, length long, modified long, uri string"


def _walk(spark: SparkSession, root: str, prune: frozenset[str]) -> list[tuple[str, int, int, str]]:
    """Every file below ``root``: names that begin with a dot or an underscore too, which Spark's own readers
    leave out.  Directories named in ``prune`` aren't entered.  A source tree's names fit on the driver."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [(top, "")]
    while todo:
        folder, below = todo.pop()
        for s in fs.listStatus(folder):
            name = s.getPath().getName()
            if s.isDirectory():
                if name not in prune:
                    todo.append((s.getPath(), f"{below}{name}/"))
            else:
                out.append((below + name, s.getLen(), s.getModificationTime(), s.getPath().toString()))
    return out


def listing(spark: SparkSession, root: str, prune: tuple[str, ...] = ()) -> DataFrame:
    """path (relative to ``root``), length, modified (ms), uri: every file, contents unread."""
    return spark.createDataFrame(_walk(spark, root, frozenset(prune)), _LISTED)


def relative(path: Column, root: str) -> Column:
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    return F.regexp_replace(F.regexp_replace(path, r"^\w+:/+", "/"), "^" + re.escape(base), "")


def display_path(path: Column, cwd: str) -> Column:
    """Relative to ``cwd`` where inside it."""
    base = cwd.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def _read(spark: SparkSession, uri: str) -> bytes:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def contents(spark: SparkSession, root: str, keep: Column | None = None, prune: tuple[str, ...] = ()) -> DataFrame:
    """path, content of the files that ``keep`` (on the relative ``path``) accepts.  Names decide first; files that
    aren't accepted are never opened."""
    names = listing(spark, root, prune)
    found = (names.filter(keep) if keep is not None else names).select("path", "uri").collect()
    plain = [r for r in found if not r["path"].rsplit("/", 1)[-1].startswith(("_", "."))]
    # Spark's readers refuse the other names, even if asked for them; these few (package files) pass the driver.
    odd = [(r["path"], bytearray(_read(spark, r["uri"]))) for r in found if r["path"].rsplit("/", 1)[-1].startswith(("_", "."))]
    out = spark.createDataFrame(odd, "path string, content binary")
    if plain:
        files = spark.read.format("binaryFile").load([r["uri"] for r in plain])
        out = out.unionByName(files.select(relative(F.col("path"), root).alias("path"), "content"))
    return out


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """The rules of every .gitignore below ``root``, outer files first; each holds below its own directory."""
    files = sorted((r for r in _walk(spark, root, frozenset(EXCLUDED_DIRS)) if r[0].rsplit("/", 1)[-1] == ".gitignore"), key=lambda r: (r[0].count("/"), r[0]))
    out = []
    for path, _, _, uri in files:
        below = re.escape(path[: -len(".gitignore")])
        for pattern, kept in gitignore_pattern(_read(spark, uri).decode("utf-8", "replace").splitlines()):
            body = pattern.removeprefix("^").removeprefix("(?:^|/)")
            out.append((f"^{below}{body}" if pattern.startswith("^") else f"^{below}(?:.*/)?{body}", kept))
    return out


def python_files(spark: SparkSession, root: str, ignore: list[str] | None = None, folder: str = "") -> DataFrame:
    """Python files (below ``folder``, if given) outside excluded directories that neither a .gitignore below
    ``root`` nor ``ignore`` leaves out."""
    rules = ignore_rules(spark, root) + gitignore_pattern(ignore or [])
    keep = is_indexable("path")
    if rules:
        keep = keep & ~gitignored("path", rules)
    if folder:
        keep = keep & F.startswith(F.col("path"), F.lit(folder.rstrip("/") + "/"))
    return contents(spark, root, keep, tuple(EXCLUDED_DIRS))


def text_lines(files: DataFrame, text: str = "text", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys, line (from 1), text: no line after a final line break, line ends trimmed; binary text (with a NUL)
    ends at it."""
    body = F.regexp_replace(F.substring_index(F.col(text), "\u0000", 1), r"\n\z", "")
    out = files.select(*keys, F.posexplode(F.split(body, "\n")).alias("_at", "_line"))
    return out.select(*keys, (F.col("_at") + 1).alias("line"), F.regexp_replace("_line", r"\r\z", "").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of JSON lines; lines that aren't JSON are skipped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def edge_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of a graph export (symbols.jsonl, edges.jsonl), renumbered so that a file's symbols
    are contiguous; double (src, dst, kind) are dropped."""
    s = spark.read.json(f"{folder}/symbols.jsonl")
    s = dense_number(Steps(spark, "export"), s, ["file", "i"], "new")
    ids = s.select("i", "new")
    e = spark.read.json(f"{folder}/edges.jsonl").dropDuplicates(["src", "dst", "kind"])
    e = e.join(ids.toDF("src", "ns"), "src").join(ids.toDF("dst", "nd"), "dst")
    return s.withColumn("i", F.col("new")).drop("new"), e.select(F.col("ns").alias("src"), F.col("nd").alias("dst"), "kind", "prov")


def read_toml(path: str) -> dict:
    return tomllib.loads(Path(path).read_text())


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def junit_cases(spark: SparkSession, path: str) -> DataFrame:
    """name, outcome (passed, failed, error, skipped) of each test case in a JUnit report."""
    rows = []
    for case in ET.parse(path).iter("testcase"):
        bad = {c.tag for c in case} & {"failure", "error", "skipped"}
        outcome = "failed" if "failure" in bad else "error" if "error" in bad else "skipped" if "skipped" in bad else "passed"
        rows.append((f"{case.get('classname', '')}::{case.get('name', '')}", outcome))
    return spark.createDataFrame(rows, "name string, outcome string")


def file_suffix(path: Column | str) -> Column:
    name = basename(path)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))
