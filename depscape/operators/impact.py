"""What a change of a symbol reaches: ranked dependents, groups, direct call sites, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import dirname, local_name
from ..model import CONFIDENCES, DEPENDENCY_KINDS, confidence, from_ordinal
from .iterate import Steps, numbered_within

MAX_CALLERS, MAX_CALLED_BY, MAX_INDIRECT_GROUPS, MAX_NAMES = 200, 3, 12, 10
EDGE = ("src", "dst", "kind", "prov", "site_line")
_RANK = {"calls": 0, "inherits": 1, "references": 2, "imports": 3}


def kind_rank(kind: Column) -> Column:
    """Calls first: they are what a changed signature breaks."""
    out = F.lit(4)
    for k, v in _RANK.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def fan_in(links: DataFrame) -> DataFrame:
    """id, fan_in: one for each edge into a symbol."""
    return links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))


def callers_count(links: DataFrame) -> DataFrame:
    """id, callers: distinct sources of edges into a symbol, containment apart."""
    return links.filter("kind <> 'contains'").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))


def described_dependents(reached: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """Dependents with their symbol, fan-in and confidence, not ranked."""
    s = symbols.select("id", "qualified", F.col("kind").alias("symbol_kind"), "path", "start_line", "end_line", "signature", "is_test")
    out = reached.join(s, "id").join(fan_in(links), "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    return out.withColumn("confidence", from_ordinal(F.col("path_conf"), CONFIDENCES))


def ranked_dependents(reached: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """Described dependents with their rank: depth, production first, confidence, fan-in, name, id.  Ranks come from
    written range partitions, as a query may reach most symbols."""
    steps = Steps(reached.sparkSession, "ranked")
    out = described_dependents(reached, symbols, links).withColumn("_less", -F.col("fan_in"))
    return numbered_within(steps, out, "query", ["depth", "is_test", "path_conf", "_less", "qualified", "id"], "rank").drop("_less")


def _by_rank(dependents: DataFrame) -> list[Column]:
    """The order of ranked dependents, or of described ones as if they were ranked."""
    if "rank" in dependents.columns:
        return [F.col("rank")]
    return [F.col("depth"), F.col("is_test"), F.col("path_conf"), F.desc("fan_in"), F.col("qualified"), F.col("id")]


def _first(dependents: DataFrame, group: list[str], name: Column, most: int, alias: str) -> DataFrame:
    """The first names of each group by rank; tasks drop later ones before rows are sent."""
    w = Window.partitionBy(*group).orderBy(*_by_rank(dependents))
    top = dependents.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select(*group, "_n", name.alias("_name"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_name"))), lambda x: x["_name"])
    return top.groupBy(*group).agg(names.alias(alias)).select(*[F.col(g).alias(f"_{g}") for g in group], alias)


def _joined(groups: DataFrame, first: DataFrame, group: list[str]) -> DataFrame:
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return groups.join(first, same, "left").drop(*[f"_{g}" for g in group])


def summary(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """query, total, prod, test over all dependents; prod_direct, prod_total, test_total without modules."""
    s = symbols.select("id", "is_test", F.col("kind").alias("symbol_kind"))
    code = F.col("symbol_kind") != "module"
    n = lambda c: F.count_if(c)
    return (
        reached.join(s, "id")
        .groupBy("query")
        .agg(
            F.count("*").alias("total"), n(~F.col("is_test")).alias("prod"), n(F.col("is_test")).alias("test"),
            n(code & ~F.col("is_test") & (F.col("depth") == 1)).alias("prod_direct"),
            n(code & ~F.col("is_test")).alias("prod_total"), n(code & F.col("is_test")).alias("test_total"),
        )
    )


def by_depth(reached: DataFrame) -> DataFrame:
    return reached.groupBy("query", "depth").agg(F.count("*").alias("n"))


def file_counts(dependents: DataFrame) -> DataFrame:
    """query, path, count, prod, test, min_depth."""
    return dependents.groupBy("query", "path").agg(
        F.count("*").alias("count"), F.count_if(~F.col("is_test")).alias("prod"), F.count_if(F.col("is_test")).alias("test"), F.min("depth").alias("min_depth")
    )


def by_file(dependents: DataFrame, names: int = MAX_NAMES) -> DataFrame:
    """query, path, count, prod, test, min_depth, names (the first by rank), omitted, of ranked or described dependents."""
    first = _first(dependents, ["query", "path"], F.col("qualified"), names, "names")
    return _joined(file_counts(dependents), first, ["query", "path"]).withColumn("omitted", F.col("count") - F.size("names"))


def by_directory(files: DataFrame) -> DataFrame:
    """query, dir, files, count, prod, test, min_depth, from the file groups."""
    return files.groupBy("query", dirname("path").alias("dir")).agg(
        F.count("*").alias("files"), F.sum("count").alias("count"), F.sum("prod").alias("prod"), F.sum("test").alias("test"), F.min("min_depth").alias("min_depth")
    )


def indirect_groups(dependents: DataFrame, most: int = MAX_INDIRECT_GROUPS) -> DataFrame:
    """query, module, count, prod, test, min_depth, top: dependents (ranked or described) at depth 2 or more by
    directory, modules left out; the groups with most production dependents."""
    far = dependents.filter("depth >= 2 and symbol_kind <> 'module'").withColumn("module", dirname("path"))
    groups = far.groupBy("query", "module").agg(
        F.count("*").alias("count"), F.count_if(~F.col("is_test")).alias("prod"), F.count_if(F.col("is_test")).alias("test"), F.min("depth").alias("min_depth")
    )
    w = Window.partitionBy("query").orderBy(F.desc("prod"), F.desc("count"), "module")
    groups = groups.withColumn("_g", F.row_number().over(w)).filter(F.col("_g") <= most).drop("_g")
    return _joined(groups, _first(far, ["query", "module"], local_name("qualified", "path"), 3, "top"), ["query", "module"])


def direct_sites(links: DataFrame, symbols: DataFrame, targets: DataFrame, kinds: tuple[str, ...] = DEPENDENCY_KINDS) -> DataFrame:
    """query, caller, lines, edge, confidence, is_test, path: one row for each caller of a query's targets
    (``targets``: query, id), its distinct lines and its strongest edge; imports left out."""
    into = targets.select("query", F.col("id").alias("dst")).distinct()
    e = links.select(*EDGE).filter(F.col("kind").isin(*kinds) & (F.col("kind") != "imports")).join(into, "dst")
    e = e.join(into.withColumnRenamed("dst", "src"), ["query", "src"], "left_anti")
    best = F.min(F.struct(kind_rank(F.col("kind")).alias("r"), confidence(F.col("prov")).alias("conf"), F.col("kind")))
    per = e.groupBy("query", F.col("src").alias("caller")).agg(F.array_sort(F.collect_set("site_line")).alias("lines"), best.alias("b"))
    s = symbols.select(F.col("id").alias("caller"), "qualified", "path", "is_test")
    return per.join(s, "caller").select("query", "caller", "qualified", "path", "is_test", "lines", F.col("b.kind").alias("edge"), F.col("b.conf").alias("confidence"))


def site_rank(sites: DataFrame) -> DataFrame:
    """Adds rank: production first, confidence, path, first line."""
    w = Window.partitionBy("query").orderBy("is_test", "confidence", "path", F.element_at("lines", 1), "caller")
    return sites.withColumn("rank", F.row_number().over(w))


def direct_summary(sites: DataFrame, links: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """query, callers, sites, files, prod, test, imported_by_files."""
    per = sites.groupBy("query").agg(
        F.count("*").alias("callers"), F.sum(F.size("lines")).alias("sites"), F.count_distinct("path").alias("files"),
        F.count_if(~F.col("is_test")).alias("prod"), F.count_if(F.col("is_test")).alias("test"),
    )
    into = targets.select("query", F.col("id").alias("dst")).distinct()
    imports = links.select(*EDGE).filter("kind = 'imports'").join(into, "dst").join(into.withColumnRenamed("dst", "src"), ["query", "src"], "left_anti")
    files = imports.join(symbols.select(F.col("id").alias("src"), "path"), "src").groupBy("query").agg(F.count_distinct("path").alias("imported_by_files"))
    out = targets.select("query").distinct().join(per, "query", "left").join(files, "query", "left")
    return out.select("query", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "sites", "files", "prod", "test", "imported_by_files")])


def called_by(sites: DataFrame, links: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = DEPENDENCY_KINDS, most: int = MAX_CALLED_BY) -> DataFrame:
    """caller, called_by (the first few local names: production first, fan-in, name), called_by_total,
    called_by_prod, called_by_prod_total: who calls each caller."""
    e = links.filter(F.col("kind").isin(*kinds) & (F.col("kind") != "imports")).select(F.col("dst").alias("caller"), F.col("src").alias("up")).distinct()
    up = sites.select("caller").distinct().join(e, "caller").filter("caller <> up")
    s = symbols.select(F.col("id").alias("up"), "is_test", local_name("qualified", "path").alias("name"))
    up = up.join(s, "up").join(fan_in(links).withColumnRenamed("id", "up"), "up", "left")
    order = ["is_test", F.desc(F.coalesce("fan_in", F.lit(0))), "name", "up"]
    up = up.withColumn("n", F.row_number().over(Window.partitionBy("caller").orderBy(*order)))
    first = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("n", "name")))), lambda x: x["name"])
    return up.groupBy("caller").agg(
        first(F.col("n") <= most).alias("called_by"), F.count("*").alias("called_by_total"),
        first(~F.col("is_test") & (F.col("n") <= most)).alias("called_by_prod"), F.count_if(~F.col("is_test")).alias("called_by_prod_total"),
    )


def fill_lines(reached: DataFrame, links: DataFrame) -> DataFrame:
    """Adds lines: where each dependent refers to the symbol it reaches the root through."""
    sites = links.groupBy(F.col("src").alias("id"), F.col("dst").alias("via")).agg(F.array_sort(F.collect_set("site_line")).alias("lines"))
    return reached.join(sites, ["id", "via"], "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<int>")))


def name_gaps(resolution: DataFrame, raw_edges: DataFrame, targets: DataFrame, kinds: tuple[str, ...] = DEPENDENCY_KINDS) -> DataFrame:
    """query, ambiguous, unresolved: references carrying a target's name that bind to no single symbol
    (``targets``: query, id, name)."""
    internal = F.col("import_path").isNull() | ~F.startswith("import_path", F.lit("<external>:"))
    e = raw_edges.filter(internal & F.col("kind").isin(*kinds)).select("path", "idx", F.col("key_name").alias("name"))
    r = resolution.filter("outcome <> 'resolved'").join(e, ["path", "idx"])
    # Counted by name and source first: targets of one name don't each meet all references, but the totals, less their own.
    gaps = ("ambiguous", "unresolved")
    by_source = r.filter("src is not null").groupBy("name", "src").agg(*[F.count_if(F.col("outcome") == g).alias(g) for g in gaps])
    by_name = by_source.groupBy("name").agg(*[F.sum(g).alias(g) for g in gaps])
    t = targets.select("query", F.col("id").alias("target"), "name").filter("target is not null")
    own = by_source.join(t.withColumnRenamed("target", "src"), ["name", "src"]).select("query", *[(-F.col(g)).alias(g) for g in gaps])
    n = t.join(by_name, "name").select("query", *gaps).unionByName(own).groupBy("query").agg(*[F.sum(g).alias(g) for g in gaps])
    out = targets.select("query").distinct().join(n, "query", "left")
    return out.select("query", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ambiguous", "unresolved")])


def risk_level(prod_direct: Column, prod_total: Column, gaps: Column) -> Column:
    return (
        F.when((prod_total == 0) & (gaps > 0), F.lit("unknown"))
        .when(prod_total == 0, F.lit("low"))
        .when((prod_direct >= 10) | (prod_total >= 50), F.lit("high"))
        .when((prod_direct >= 3) | (prod_total >= 10), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def risk_reason(prod_direct: Column, prod_total: Column, gaps: Column) -> Column:
    """The sentence that goes with a risk level."""
    s = lambda c: c.cast("string")
    hidden = F.concat(F.lit("no production dependents found, but "), s(gaps), F.lit(" unresolved/ambiguous references with this name could hide some"))
    counts = F.concat(s(prod_direct), F.lit(" direct / "), s(prod_total), F.lit(" total production dependents"))
    bound = F.concat(counts, F.lit("; lower bound: "), s(gaps), F.lit(" unresolved/ambiguous references"))
    none = F.lit("no production dependents and no unresolved references with this name")
    return F.when((prod_total == 0) & (gaps > 0), hidden).when(prod_total == 0, none).when(gaps > 0, bound).otherwise(counts)


def assess(counts: DataFrame) -> DataFrame:
    """Adds level and reason to prod_direct, prod_total, gaps."""
    a = (F.col("prod_direct"), F.col("prod_total"), F.col("gaps"))
    return counts.withColumns({"level": risk_level(*a), "reason": risk_reason(*a)})


def completeness(causes: tuple[str, ...]) -> Column:
    """``lower_bound`` if any cause is above 0, else ``complete``."""
    any_ = F.lit(False)
    for c in causes:
        any_ = any_ | (F.col(c) > 0)
    return F.when(any_, F.lit("lower_bound")).otherwise(F.lit("complete"))
