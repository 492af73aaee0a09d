"""One object for a repository: index it, ask it, keep it current."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import local_name
from .operators import impact, search
from .operators.diff import git_diff
from .plans import answer, shell
from .sources import tree
from .streaming.index import GraphStore


@dataclass
class Repository:
    """A source tree and the store of its graph (a folder that all executors share)."""

    spark: SparkSession
    root: str
    store_path: str
    ignore: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        self.store = GraphStore(self.spark, self.store_path)

    # --- index ---

    def index(self) -> int:
        """Reconciles the graph with the tree; the revision after it."""
        self.store.sync(tree.python_files(self.spark, self.root, list(self.ignore)))
        return self.store.rev()

    def nudge(self, path: str) -> int:
        """Reconciles one folder, or the folder of one file."""
        folder = path if not path.endswith(".py") else path.rsplit("/", 1)[0] if "/" in path else ""
        files = tree.python_files(self.spark, self.root, list(self.ignore), folder)
        self.store.sync_folder(files, folder) if folder else self.store.sync(files)
        return self.store.rev()

    def status(self) -> dict:
        """Revision, counts of files, symbols and edges by outcome, and files that didn't parse."""
        outcomes = {r["outcome"]: r["n"] for r in self.store.read("resolution").groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        return {
            "graph_rev": self.store.rev(), "files": self.store.read("file").count(), "symbols": self.store.read("symbol").count(),
            "edges": outcomes, "parse_failures": self.store.parse_failures(),
        }

    def graph(self, stale: bool = False) -> answer.Graph:
        rev = self.store.rev()
        t = lambda n: self.store.read(n, rev)
        read = lambda paths: tree.contents(self.spark, self.root, F.col("path").isin(*paths))
        return answer.Graph(t("symbol"), self.store.links(rev), t("resolution"), t("raw_edge"), rev, stale, self.store.parse_failures(), read=read)

    # --- questions ---

    def lookup(self, ref: str) -> dict:
        return answer.lookup_document(self.graph(), ref)

    def blast(self, ref: str, options: answer.Options | None = None) -> dict:
        return answer.blast_document(self.graph(), ref, options)

    def diff_impact(self, base: str = "HEAD", options: answer.Options | None = None) -> dict:
        hunks = git_diff(self.spark, self.root, base).withColumnRenamed("seq", "hunk_id")
        return answer.diff_document(self.graph(), hunks, options)

    def search(self, spec: search.SearchSpec) -> DataFrame:
        """Judged matches of a search, definitions first, then uses and imports, tests after the rest."""
        files = tree.contents(self.spark, self.root, search.accepted(spec, F.col("path")), () if spec.no_ignore else tuple(tree.NOISE_DIRS))
        files = files.select("path", F.decode("content", "UTF-8").alias("text"))
        hits = search.search(files, spec)
        g = self.graph()
        judged = search.judge(hits, files, g.symbols, g.links, g.resolution, g.raw_edges, search.identifiers(spec))
        rank = F.array_position(F.array(*[F.lit(c) for c in search.CLASSES]), F.col("class"))
        return judged.withColumn("rank", rank).orderBy("rank", "seq")

    def command(self, text: str) -> DataFrame | None:
        """A shell search with its filters as a judged search; None for any other command."""
        plans = shell.plan(text)
        if not plans or len(plans) != 1 or plans[0][1] is None:
            return None
        p = plans[0][1]
        out = self.search(p.spec).withColumn("rendered", F.concat_ws(":", "path", F.col("line").cast("string"), "text"))
        for s in p.stages:
            if s.kind == "drop_tests":
                out = out.filter(~F.col("path").rlike(r"(^|/)tests?/|(^|/)test_|_test\.py$|(^|/)conftest\.py$"))
            elif s.kind == "line":
                out = search.line_filter(out, s.pattern, s.fixed, s.word, s.ignore_case, s.invert)
            elif s.kind == "budget" and s.lines:
                out = out.limit(s.lines)
        return out

    # --- summaries ---

    def file_info(self, path: str, most: int = 8) -> dict:
        """Symbols of a file, the most called first."""
        g = self.graph()
        s = g.symbols.filter((F.col("path") == path) & (F.col("kind") != "module"))
        top = s.join(impact.callers_count(g.links), "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
        rows = top.orderBy(F.desc("callers"), "start_line").limit(most).select(local_name("qualified", "path").alias("name"), "kind", "start_line", "end_line", "callers").collect()
        return {"path": path, "symbols": s.count(), "top": [r.asDict() for r in rows]}

    def dir_info(self, folder: str, most: int = 5) -> dict:
        """Files and symbols below a folder, and its most called symbols."""
        g = self.graph()
        s = g.symbols.filter(F.startswith("path", F.lit(folder.rstrip("/") + "/")))
        top = s.filter("kind <> 'module'").join(impact.callers_count(g.links), "id")
        rows = top.orderBy(F.desc("callers"), "qualified").limit(most).select(local_name("qualified", "path").alias("name"), "path", "callers").collect()
        n = s.agg(F.count_distinct("path").alias("files"), F.count_if(F.col("kind") != "module").alias("symbols")).first()
        return {"path": folder, "files": n["files"], "symbols": n["symbols"], "top": [r.asDict() for r in rows]}

    def name_info(self, name: str) -> list[dict]:
        """Every symbol of a name with its callers."""
        g = self.graph()
        s = g.symbols.filter(F.col("name") == name).join(impact.callers_count(g.links), "id", "left")
        rows = s.select("qualified", "kind", "path", "start_line", F.coalesce("callers", F.lit(0)).alias("callers")).orderBy("qualified", "path").limit(search.MAX_NAME_SYMBOLS)
        return [r.asDict() for r in rows.collect()]
