"""The incremental index: file changes to a graph that always equals a full rebuild.

A commit writes one new revision of the tables (file, symbol, raw_edge, resolution) under the store's
folder and publishes it by writing the manifest last; readers pin a revision.  Only edges that a change
can affect are resolved again: those of the changed files, those that look up a changed name, those
bound to a symbol of a changed file, those whose import starts with a changed name, and, if classes or
their bases changed, those on self-like receivers.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import model
from ..functions.expr import import_head
from ..model import SELF_RECEIVERS
from ..operators.resolve import links, resolve
from ..sources.python_facts import extract_facts, file_table, raw_edge_table, symbol_table

TABLES = {"file": model.FILE, "symbol": model.SYMBOL, "raw_edge": model.RAW_EDGE, "resolution": model.RESOLUTION}
LAYOUT = 1
_SIGNATURE = ["id", "name", "qualified", "kind", "lang", "parent"]
_INHERITS = ["src", "dst_id", "key_name", "qualifier", "import_path"]


@dataclass
class Delta:
    """What a commit touched."""

    rev: int
    paths: DataFrame
    names: DataFrame
    ids: DataFrame
    classes: bool
    removed_keys: DataFrame


class GraphStore:
    """Revisions of the fact and resolution tables in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        if self._manifest() is None:
            self._publish(0, {}, 0)
        elif self._manifest()["layout"] != LAYOUT:  # another layout: start again
            self._publish(self.rev() + 1, {}, 0)

    # --- manifest: one small JSON file a revision; the highest is the state ---

    def _fs(self):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _manifest(self, rev: int | None = None) -> dict | None:
        fs, folder = self._fs()
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        revs = sorted(int(n) for n in names if n.isdigit())
        if not revs:
            return None
        at = rev if rev is not None else revs[-1]
        row = self.spark.read.schema("rev long, layout int, offset long, tables map<string,string>").json(f"{self.root}/manifest/{at}").first()
        return row.asDict() if row else None

    def _publish(self, rev: int, tables: dict[str, str], offset: int) -> None:
        row = self.spark.createDataFrame([(rev, LAYOUT, offset, tables)], "rev long, layout int, offset long, tables map<string,string>")
        pending = f"{self.root}/pending-{rev}"
        row.coalesce(1).write.mode("overwrite").json(pending)
        fs, folder = self._fs()
        fs.mkdirs(folder)
        jvm = self.spark.sparkContext._jvm
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(pending), jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{rev}")):
            raise RuntimeError(f"revision {rev} was published by another writer")

    def rev(self) -> int:
        return self._manifest()["rev"]

    def offset(self) -> int:
        """Sequence number of the last change that is in the graph."""
        return self._manifest()["offset"]

    def read(self, table: str, rev: int | None = None) -> DataFrame:
        path = self._manifest(rev)["tables"].get(table)
        if path is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(path)

    def links(self, rev: int | None = None) -> DataFrame:
        return links(self.read("resolution", rev))

    # --- writing ---

    def commit(self, changes: DataFrame, offset: int | None = None) -> Delta | None:
        """Applies changes (path, content; null content: removed), the last of each path if it has ``seq``.

        Files whose hash is the stored one are left alone; None if nothing is left."""
        if "seq" in changes.columns:
            last = changes.groupBy("path").agg(F.max_by("content", "seq").alias("content"))
        else:
            # Without an order, of several contents the greatest counts, and any content before a removal.
            last = changes.groupBy("path").agg(F.max("content").alias("content"))
        rev = self.rev() + 1
        base = f"{self.root}/data/{rev}"
        last.withColumn("content_hash", F.sha2("content", 256)).write.mode("overwrite").parquet(f"{base}/changes")
        last = self.spark.read.parquet(f"{base}/changes")
        old_file = self.read("file")
        same = old_file.select("path", "content_hash")
        gone = last.filter("content is null").join(old_file.select("path"), "path", "left_semi")
        live = last.filter("content is not null").join(same, ["path", "content_hash"], "left_anti")
        paths = gone.select("path").union(live.select("path"))
        paths = self._keep(paths, f"{base}/paths")
        if not paths.limit(1).count():
            return None
        facts = self._keep(extract_facts(live), f"{base}/facts")
        new = {"file": file_table(facts), "symbol": symbol_table(facts), "raw_edge": raw_edge_table(facts)}
        old = {t: self.read(t) for t in TABLES}
        of_paths = {t: old[t].join(paths, "path", "left_semi") for t in ("symbol", "raw_edge")}
        delta = self._delta(rev, paths, of_paths, new, base)
        written = {}
        for t in ("file", "symbol", "raw_edge"):
            merged = old[t].join(paths, "path", "left_anti").unionByName(new[t].select(*old[t].columns))
            written[t] = self._keep(merged, f"{base}/{t}")
        todo = self.affected(written["raw_edge"], delta)
        todo = self._keep(todo, f"{base}/todo")
        kept = old["resolution"].join(delta.paths, "path", "left_anti").join(todo, ["path", "idx"], "left_anti")
        fresh = resolve(written["symbol"], written["raw_edge"], todo)
        written["resolution"] = self._keep(kept.unionByName(fresh.select(*kept.columns)), f"{base}/resolution")
        self._publish(rev, {t: f"{base}/{t}" for t in TABLES}, self.offset() if offset is None else offset)
        return delta

    def _keep(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delta(self, rev: int, paths: DataFrame, old: dict[str, DataFrame], new: dict[str, DataFrame], base: str) -> Delta:
        a, b = old["symbol"].select(*_SIGNATURE), new["symbol"].select(*_SIGNATURE)
        changed = self._keep(a.exceptAll(b).unionByName(b.exceptAll(a)), f"{base}/changed")
        inherits = lambda df: df.filter("kind = 'inherits'").select(*_INHERITS).distinct()
        i, j = inherits(old["raw_edge"]), inherits(new["raw_edge"])
        classes = changed.filter("kind = 'class'").limit(1).count() or i.exceptAll(j).union(j.exceptAll(i)).limit(1).count()
        ids = self._keep(old["symbol"].select("id").union(new["symbol"].select("id")).distinct(), f"{base}/ids")
        keys = self._keep(old["raw_edge"].select("path", "idx"), f"{base}/removed")
        return Delta(rev, paths, changed.select("name").distinct(), ids, bool(classes), keys)

    def affected(self, raw_edges: DataFrame, delta: Delta) -> DataFrame:
        """path, idx of the edges that the change can affect."""
        e = raw_edges.withColumn("head", import_head("import_path"))
        parts = [
            e.join(delta.paths, "path", "left_semi"),
            e.join(delta.names.withColumnRenamed("name", "key_name"), "key_name", "left_semi"),
            e.join(delta.ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi"),
            e.join(delta.names.withColumnRenamed("name", "head"), "head", "left_semi"),
        ]
        if delta.classes:
            parts.append(e.filter(F.col("qualifier").isin(*SELF_RECEIVERS)))
        out = parts[0].select("path", "idx")
        for p in parts[1:]:
            out = out.union(p.select("path", "idx"))
        return out.distinct()

    def sync(self, files: DataFrame) -> Delta | None:
        """Full reconciliation with a tree (path, content): changed files are written, vanished ones removed."""
        vanished = self.read("file").select("path").join(files.select("path"), "path", "left_anti")
        return self.commit(files.select("path", "content").unionByName(vanished.select("path", F.lit(None).cast("binary").alias("content"))))

    def sync_folder(self, files: DataFrame, folder: str) -> Delta | None:
        """The same below one folder."""
        inside = F.startswith("path", F.lit(folder.rstrip("/") + "/"))
        vanished = self.read("file").select("path").filter(inside).join(files.select("path"), "path", "left_anti")
        return self.commit(files.filter(inside).select("path", "content").unionByName(vanished.select("path", F.lit(None).cast("binary").alias("content"))))

    def parse_failures(self) -> int:
        return self.read("file").filter("not parse_ok").count()

    def rebuilt(self) -> DataFrame:
        """Resolution of all edges from the fact tables alone."""
        return resolve(self.read("symbol"), self.read("raw_edge"))

    # --- streaming ---

    def follow(self, changes: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """Commits every micro-batch of a change stream (seq, path, content).  A batch that was committed before
        a restart brings the same hashes and changes nothing."""

        def apply(batch: DataFrame, _: int) -> None:
            last = batch.agg(F.max("seq")).first()[0]
            if last is not None and self.commit(batch, int(last)) is None and last > self.offset():
                self._publish(self.rev() + 1, self._manifest()["tables"], int(last))

        w = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()

    def wait(self, target: int, most_ms: int = 200, step_ms: int = 20) -> bool:
        """Waits for a change to be in the graph; True if the answer would be stale."""
        end = time.monotonic() + most_ms / 1000
        while self.offset() < target:
            if time.monotonic() >= end:
                return True
            time.sleep(step_ms / 1000)
        return False


def batches(events: DataFrame, gap: str, key: list[str] | None = None) -> DataFrame:
    """Change events (ts, path) in sessions: a batch closes after ``gap`` without events; each path once."""
    return events.groupBy(*(key or []), F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("events"), F.array_sort(F.collect_set("path")).alias("paths"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def repeated_within(stream: DataFrame, keys: list[str], ts: str, window: str) -> DataFrame:
    """The first event of each key within a time window, for streams: later repeats are dropped."""
    return stream.withWatermark(ts, window).dropDuplicatesWithinWatermark(keys)
