"""Registered queries over the tables' views, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.expr import dirname, estimate_tokens, last_segment, local_name, nearest_rank, numbered, shared_dirs
from .model import DEPENDENCY_KINDS
from .operators import analytics, diff, graph, impact, ladder, lookup, resolve, search, traverse
from .sources import driver_tables as d
from .streaming.index import batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_DEP = "(" + ", ".join(f"'{k}'" for k in DEPENDENCY_KINDS) + ")"
TARGETS = ("s7", "s42", "p11", "c5", "n3")


def _views(*names: str) -> str:
    return ",\n".join(f"{n} as ({d.SQL[n]})" for n in names)


def query(sql: str | None, *views: str):
    """Registers a query; ``sql`` may use the named views, and more tables of its own after them."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = _views(*views)
            body = sql.strip()
            ORACLE[f.__name__] = (f"with {head}{', ' if body.startswith('+') else ' '}{body.lstrip('+')}" if head else body)
        return f

    return add


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TARGETS], "target string")


def _roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, t) for t in TARGETS], "query string, id string")


_T = "(values " + ", ".join(f"('{t}')" for t in TARGETS) + ")"


def _levels(kinds: str = _DEP, depth: int = 3, where: str = "true") -> str:
    """SQL of the dependents of the targets, level by level, with the choice of path."""
    sql = [
        f"t(query) as ({_T})",
        f"""e as (select dst, src, case kind when 'calls' then 0 when 'imports' then 1 when 'inherits' then 2 when 'references' then 4 else 5 end as k, kind,
            min(case when prov in ('extracted', 'resolved') then 0 when prov = 'inferred' then 1 else 2 end) as conf
            from v_link where kind in {kinds} and {where} group by all)""",
        "l0 as (select query, query as id, 0 as depth, null as via, null as kind, null::int as edge_conf, 0 as path_conf from t)",
    ]
    seen = "select query, id from l0"
    for n in range(1, depth + 1):
        sql.append(f"""l{n} as (select query, src as id, {n} as depth, dst as via, kind, conf as edge_conf, pc as path_conf from (
            select l.query, e.src, e.dst, e.kind, e.conf, greatest(l.path_conf, e.conf) as pc,
              row_number() over (partition by l.query, e.src order by greatest(l.path_conf, e.conf), e.conf, e.dst, e.k) as rn
            from l{n - 1} l join e on e.dst = l.id where (l.query, e.src) not in ({seen})) where rn = 1)""")
        seen += f" union all select query, id from l{n}"
    sql.append("reached as (" + " union all ".join(f"select * from l{n}" for n in range(1, depth + 1)) + ")")
    return ", ".join(sql)


_BLAST = f"""+ t(target) as ({_T}), e as (select distinct src, dst from v_link where kind in {_DEP}),
l1 as (select distinct target, src as id from t join e on e.dst = target where src <> target),
l2 as (select distinct l1.target, e.src as id from l1 join e on e.dst = l1.id where (l1.target, e.src) not in (select * from l1) and e.src <> l1.target),
l3 as (select distinct l2.target, e.src as id from l2 join e on e.dst = l2.id
  where (l2.target, e.src) not in (select * from l1 union all select * from l2) and e.src <> l2.target),
r as (select *, 1 as depth from l1 union all select *, 2 from l2 union all select *, 3 from l3)
"""


@query(_BLAST + "select target, id, depth from r", "v_link")
def blast_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.blast_radius(d.links(spark, sf), _targets(spark))


@query(_BLAST + "select target, id, depth from r", "v_link")
def blast_cte(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.blast_radius_sql(spark, d.links(spark, sf), _targets(spark))


@query(_BLAST.replace("from v_link where", "from v_link where prov in ('extracted', 'resolved') and") + "select target, id, depth from r", "v_link")
def blast_trusted(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.blast_radius(traverse.trusted_links(d.links(spark, sf)), _targets(spark))


@query(_BLAST + "select target, depth, count(*)::bigint as n from r group by all", "v_link")
def blast_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    return blast_bfs(spark, sf).groupBy("target", "depth").agg(F.count("*").alias("n"))


def _reached(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return traverse.dependents(d.links(spark, sf, repeats=True), _roots(spark))


def _described(spark: SparkSession, sf: str) -> DataFrame:
    return impact.described_dependents(_reached(spark, sf)[0], d.symbols(spark, sf).withColumn("signature", F.lit("")), d.links(spark, sf))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return impact.ranked_dependents(_reached(spark, sf)[0], d.symbols(spark, sf).withColumn("signature", F.lit("")), d.links(spark, sf))


@query(f"+ {_levels()} select query, id, depth, via, kind, edge_conf, path_conf from reached", "v_link")
def dependents_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _reached(spark, sf)[0]


_RANKED = f"""+ {_levels()}, f as (select dst as id, count(*) as fan_in from v_link group by 1),
ranked as (select r.*, s.qualified, s.kind as symbol_kind, s.path, s.is_test, coalesce(f.fan_in, 0) as fan_in,
  row_number() over (partition by query order by depth, is_test, path_conf, coalesce(f.fan_in, 0) desc, qualified, r.id) as rank
  from reached r join v_symbol s using (id) left join f using (id))
"""


@query(_RANKED + "select query, rank::int as rank, id, depth, fan_in::bigint as fan_in from ranked", "v_symbol", "v_link")
def dependents_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select("query", "rank", "id", "depth", "fan_in")


_BY_FILE = """select query, path, count(*)::bigint as count, count(*) filter (not is_test)::bigint as prod, count(*) filter (is_test)::bigint as test, min(depth) as min_depth,
  string_agg(case when n <= 10 then qualified end, ';' order by n) as names, count(*) filter (n > 10)::int as omitted
from (select *, row_number() over (partition by query, path order by rank) as n from ranked) group by all"""


@query(_RANKED + _BY_FILE, "v_symbol", "v_link")
def dependents_by_file(spark: SparkSession, sf: str) -> DataFrame:
    out = impact.by_file(_described(spark, sf))
    return out.withColumn("names", F.array_join("names", ";")).withColumn("omitted", F.col("omitted").cast("int"))


@query(
    _RANKED
    + f""", files as ({_BY_FILE}) select query, regexp_replace(path, '/[^/]*$', '') as dir, count(*)::bigint as files, sum(count)::bigint as count,
sum(prod)::bigint as prod, sum(test)::bigint as test, min(min_depth) as min_depth from files where contains(path, '/') group by all""",
    "v_symbol", "v_link",
)
def dependents_by_dir(spark: SparkSession, sf: str) -> DataFrame:
    return impact.by_directory(impact.file_counts(_reached(spark, sf)[0].join(d.symbols(spark, sf).select("id", "path", "is_test"), "id")))


@query(f"+ {_levels()} select query, depth, path_conf, count(*)::bigint as n from reached group by all", "v_link")
def path_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _reached(spark, sf)[0].groupBy("query", "depth", "path_conf").agg(F.count("*").alias("n"))


@query(
    f"""+ {_levels(depth=1)}, seen as (select query, id from l0 union all select query, id from l1),
more as (select distinct l1.query, l1.id from l1 join e on e.dst = l1.id where (l1.query, e.src) not in (select query, id from seen))
select t.query, count(more.id)::bigint as beyond from t left join more using (query) group by 1""",
    "v_link",
)
def beyond_depth(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.dependents(d.links(spark, sf), _roots(spark), 1)[1].select("query", F.col("beyond").cast("long").alias("beyond"))


@query(
    f"""+ {_levels()}, c as (select query, count(*) filter (s.kind <> 'module' and not is_test and depth = 1) as pd, count(*) filter (s.kind <> 'module' and not is_test) as pt,
  count(*) filter (s.kind <> 'module' and is_test) as tt from reached join v_symbol s using (id) group by 1)
select query, pd::bigint as prod_direct, pt::bigint as prod_total, tt::bigint as test_total,
  case when pt = 0 then 'low' when pd >= 10 or pt >= 50 then 'high' when pd >= 3 or pt >= 10 then 'medium' else 'low' end as level,
  case when pt = 0 then 'no production dependents and no unresolved references with this name' else pd || ' direct / ' || pt || ' total production dependents' end as reason from c""",
    "v_symbol", "v_link",
)
def risk_assess(spark: SparkSession, sf: str) -> DataFrame:
    s = impact.summary(_reached(spark, sf)[0], d.symbols(spark, sf)).withColumn("gaps", F.lit(0))
    return impact.assess(s).select("query", "prod_direct", "prod_total", "test_total", "level", "reason")


_REFS = ("part.Brand#2.small ring", "small ring", "red widget", "EUROPE.FRANCE", "FRANCE", "nope", "s.nope", "17", "ASIA.INDIA.17")


@query(
    f"""+ q(ref) as (values {", ".join(f"('{r}')" for r in _REFS)}),
m as (select ref, id, qualified, path, case when not contains(ref, '.') or qualified = ref then 2 when ends_with(qualified, '.' || ref) then 1 else 0 end as fit
  from q join v_symbol on name = list_extract(string_split(ref, '.'), -1)),
b as (select *, row_number() over (partition by ref order by qualified, path, id) as rank, count(*) over (partition by ref) as n
  from (select *, max(fit) over (partition by ref) as best from m where fit > 0) where fit = best)
select ref, case when n is null then 'not_found' when n = 1 then 'found' else 'ambiguous' end as status, coalesce(n, 0)::bigint as n, rank::int as rank, id, qualified, path
from q left join (select * from b where rank <= 20) b using (ref)""",
    "v_symbol",
)
def lookup_refs(spark: SparkSession, sf: str) -> DataFrame:
    refs = spark.createDataFrame([(r,) for r in _REFS], "ref string")
    return lookup.lookup(d.symbols(spark, sf), refs)


_SITES = f"""+ t(query) as ({_T}), e as (select query, src as caller, site_line, kind,
  case kind when 'calls' then 0 when 'inherits' then 1 when 'references' then 2 else 4 end as r, case when prov in ('extracted', 'resolved') then 0 when prov = 'inferred' then 1 else 2 end as conf
  from v_link join t on dst = query where kind in {_DEP} and kind <> 'imports' and src <> query),
sites as (select query, caller, list_sort(list(distinct site_line)) as lines, min((r, conf, kind)) as b from e group by all)
"""


@query(
    _SITES + "select query, caller, path, array_to_string(lines, ',') as lines, b[3] as edge, b[2]::int as confidence from sites join v_symbol on id = caller",
    "v_symbol", "v_link",
)
def direct_sites(spark: SparkSession, sf: str) -> DataFrame:
    out = impact.direct_sites(d.links(spark, sf), d.symbols(spark, sf), _roots(spark))
    return out.select("query", "caller", "path", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), "edge", "confidence")


@query(
    _SITES
    + """, n as (select query, count(*) as callers, sum(len(lines)) as sites, count(distinct path) as files, count(*) filter (not is_test) as prod, count(*) filter (is_test) as test
  from sites join v_symbol on id = caller group by 1),
i as (select t.query, count(distinct s.path) as f from t join v_link l on l.dst = t.query and l.kind = 'imports' join v_symbol s on s.id = l.src group by 1)
select t.query, coalesce(callers, 0)::bigint as callers, coalesce(sites, 0)::bigint as sites, coalesce(files, 0)::bigint as files, coalesce(prod, 0)::bigint as prod,
  coalesce(test, 0)::bigint as test, coalesce(f, 0)::bigint as imported_by_files from t left join n using (query) left join i using (query)""",
    "v_symbol", "v_link",
)
def direct_summary(spark: SparkSession, sf: str) -> DataFrame:
    links, symbols, roots = d.links(spark, sf), d.symbols(spark, sf), _roots(spark)
    return impact.direct_summary(impact.direct_sites(links, symbols, roots), links, symbols, roots)


@query(
    """+ f as (select dst as up, count(*) as n from v_link group by 1),
u as (select distinct l.dst as caller, l.src as up from v_link l where kind in ('calls', 'inherits', 'references', 'tests') and l.src <> l.dst),
r as (select caller, name, is_test, row_number() over (partition by caller order by is_test, coalesce(n, 0) desc, name, up) as k from (
  select u.*, s.is_test, s.qualified as name, f.n from u join v_symbol s on s.id = u.up left join f using (up)))
select caller, string_agg(name, ';' order by k) filter (k <= 3) as called_by, count(*)::bigint as called_by_total, count(*) filter (not is_test)::bigint as called_by_prod_total from r group by 1""",
    "v_symbol", "v_link",
)
def called_by_top3(spark: SparkSession, sf: str) -> DataFrame:
    links, symbols = d.links(spark, sf), d.symbols(spark, sf)
    out = impact.called_by(symbols.select(F.col("id").alias("caller")), links, symbols)
    return out.select("caller", F.array_join("called_by", ";").alias("called_by"), "called_by_total", "called_by_prod_total")


@query(
    _RANKED
    + """, g as (select query, regexp_replace(path, '/[^/]*$', '') as module, case when id like 'p%' then regexp_replace(qualified, '^part[.][^.]+[.]', '') else qualified end as name, is_test, depth,
  row_number() over (partition by query, regexp_replace(path, '/[^/]*$', '') order by rank) as n from ranked where depth >= 2 and symbol_kind <> 'module'),
h as (select query, module, count(*) as count, count(*) filter (not is_test) as prod, count(*) filter (is_test) as test, min(depth) as min_depth,
  string_agg(name, ';' order by n) filter (n <= 3) as top from g group by all)
select query, module, count::bigint as count, prod::bigint as prod, test::bigint as test, min_depth, top from (
  select *, row_number() over (partition by query order by prod desc, count desc, module) as k from h) where k <= 12""",
    "v_symbol", "v_link",
)
def indirect_groups(spark: SparkSession, sf: str) -> DataFrame:
    return impact.indirect_groups(_described(spark, sf)).withColumn("top", F.array_join("top", ";"))


@query(
    _BLAST.replace(_DEP, "('calls', 'references')")
    + "select target, id, depth from (select target, target as id, 0 as depth from t union all select target, id, depth from r) join (select id from v_symbol where is_test) using (id)",
    "v_symbol", "v_link",
)
def covering_tests(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.covering_tests(d.links(spark, sf), d.symbols(spark, sf), _targets(spark))


# Nations as classes: the first of a region is the base of the others; suppliers are methods of seven names.
_CLASSES = """+ base as (select n_regionkey, min(n_nationkey) as b from nation group by 1),
cls as (select 'n' || n_nationkey as src, 'n' || b as dst from nation join base using (n_regionkey) where n_nationkey <> b),
meth as (select 's' || s_suppkey as id, 'm' || (s_suppkey % 7) as name, 'n' || s_nationkey as parent, s_suppkey::int as start_line from supplier)
"""


@query(
    _CLASSES
    + """select a.id, 'overrides' as relation, b.id as other, b.start_line from meth a join cls on cls.src = a.parent join meth b on b.parent = cls.dst and b.name = a.name
union all select a.id, 'overridden_by', b.id, b.start_line from meth a join cls on cls.dst = a.parent join meth b on b.parent = cls.src and b.name = a.name""",
    "v_user",
)
def overrides(spark: SparkSession, sf: str) -> DataFrame:
    n, s = d.table(spark, sf, "nation"), d.table(spark, sf, "supplier")
    base = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("b"))
    cls = n.join(base, "n_regionkey").filter("n_nationkey <> b")
    nid = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    links = cls.select(nid("n_nationkey").alias("src"), nid("b").alias("dst"), F.lit("inherits").alias("kind"), F.lit("extracted").alias("prov"))
    name = F.concat(F.lit("m"), (F.col("s_suppkey") % 7).cast("string"))
    symbols = s.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), name.alias("name"), nid("s_nationkey").alias("parent"),
        F.col("s_suppkey").cast("int").alias("start_line"), F.lit("").alias("path"), name.alias("qualified"),
    )
    return traverse.overrides(links, symbols, symbols.select("id")).select("id", "relation", "other", "start_line")


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as references of five shapes, by line number: bound, by import path, by receiver, by name, external."""
    li, p = d.table(spark, sf, "lineitem"), d.table(spark, sf, "part")
    j = li.select("l_orderkey", "l_linenumber", "l_partkey").distinct().join(p.select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    shape = F.col("l_linenumber") % 5
    order = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    path = F.when(shape == 1, F.concat_ws(".", F.lit("part"), "p_brand", "p_name")).when(shape == 4, F.concat(F.lit("<external>:x."), F.col("p_name")))
    return j.select(
        F.concat_ws("/", order, F.col("l_partkey").cast("string")).alias("path"), F.col("l_linenumber").cast("int").alias("idx"), F.lit("python").alias("lang"), order.alias("src"), F.lit("calls").alias("kind"),
        F.col("l_linenumber").cast("int").alias("site_line"), F.when(shape == 0, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("dst_id"),
        F.when(shape != 0, F.col("p_name")).alias("name"), F.when(shape != 0, F.col("p_name")).alias("key_name"), F.when(shape == 2, F.col("p_brand")).alias("qualifier"),
        path.alias("import_path"), F.lit("extracted").alias("prov"),
    )


_RESOLVE = """+ e as (select distinct 'o' || l_orderkey || '/' || l_partkey as path, l_linenumber as idx, l_linenumber % 5 as shape, l_partkey, p_name, p_brand from lineitem join part on l_partkey = p_partkey),
byq as (select p_brand, p_name, count(*) as n, min('p' || p_partkey) as one from part group by all),
byn as (select p_name, count(*) as n, min('p' || p_partkey) as one from part group by 1),
o as (select path, idx,
  case when shape = 0 then 1 when shape in (1, 2) then q.n when shape = 3 then m.n else 0 end as n,
  case when shape = 0 then 'p' || l_partkey when shape in (1, 2) then q.one when shape = 3 then m.one end as one,
  case when shape = 0 then 'extracted' when shape = 1 then 'resolved' when shape = 2 then 'inferred' else 'name_guess' end as prov
  from e join byq q using (p_brand, p_name) join byn m using (p_name)),
res as (select path, idx::int as idx, case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unresolved' end as outcome, case when n = 1 then one end as dst,
  case when n = 1 then prov end as provenance, case when n > 1 then n end::int as candidates from o)
"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve(d.symbols(spark, sf), raw_edges(spark, sf))


@query(_RESOLVE + "select path, idx, outcome, dst, provenance, candidates from res", "v_user")
def resolve_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("path", "idx", "outcome", "dst", "provenance", "candidates")


@query(
    _RESOLVE.replace("e as (", "names as (select 'p' || p_partkey as id, p_name from part), e as (")
    + """select n.id as query, count(*) filter (outcome = 'ambiguous')::bigint as ambiguous, count(*) filter (outcome = 'unresolved')::bigint as unresolved
from names n left join (select p_name, outcome from res join e using (path, idx) where shape in (1, 2, 3)) using (p_name) group by 1""",
    "v_user",
)
def name_gaps(spark: SparkSession, sf: str) -> DataFrame:
    targets = d.symbols(spark, sf).filter("id like 'p%'").select(F.col("id").alias("query"), "id", "name")
    return impact.name_gaps(_resolved(spark, sf), raw_edges(spark, sf), targets)


@query("select fan_in::bigint as fan_in, count(*)::bigint as n from (select id, count(dst) as fan_in from v_symbol left join v_link on dst = id group by 1) group by 1", "v_symbol", "v_link")
def fan_in_dist(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shape(d.symbols(spark, sf), d.links(spark, sf))["fan_in"]


@query("select id, qualified, count(dst)::bigint as fan_in from v_symbol left join v_link on dst = id group by 1, 2 order by fan_in desc, id limit 20", "v_symbol", "v_link")
def top_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shape(d.symbols(spark, sf), d.links(spark, sf))["hubs"]


@query("select kind, prov, count(*)::bigint as n from v_link group by all", "v_link")
def edge_shape(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shape(d.symbols(spark, sf), d.links(spark, sf))["edge_kinds"]


@query(
    """select string_split(s.path, '/')[1] as grp, count(distinct s.path)::bigint as files, count(distinct s.id)::bigint as symbols, count(l.dst)::bigint as edges_out,
count(*) filter (string_split(t.path, '/')[1] = string_split(s.path, '/')[1])::bigint as edges_internal from v_symbol s left join v_link l on l.src = s.id left join v_symbol t on t.id = l.dst group by 1""",
    "v_symbol", "v_link",
)
def shape_groups(spark: SparkSession, sf: str) -> DataFrame:
    s = d.symbols(spark, sf).select("id", "path", analytics.group_of(F.col("path"), []).alias("grp"))
    out = s.groupBy("grp").agg(F.count_distinct("path").alias("files"), F.count("*").alias("symbols"))
    e = d.links(spark, sf).join(s.select(F.col("id").alias("src"), "grp"), "src").join(s.select(F.col("id").alias("dst"), F.col("grp").alias("to")), "dst", "left")
    e = e.groupBy("grp").agg(F.count("*").alias("edges_out"), F.count_if(F.col("grp") == F.col("to")).alias("edges_internal"))
    return out.join(e, "grp", "left").na.fill(0)


@query(
    """select 0::bigint as src, id as dst, min(hops)::int as hops from (
  with recursive r(id, hops) using key (id) as (select 0::bigint, 0 union select e.dst, min(r.hops) + 1 from r join v_user e on e.src = r.id
    where not exists (from recurring.r as k where k.id = e.dst) group by 1) select id, hops from r) group by all""",
    "v_user",
)
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    e = d.user_graph(spark, sf)
    nodes = graph.nodes_of(e)
    pairs = nodes.select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    return graph.shortest_path(e, pairs, max_hops=max(1, nodes.count())).filter("hops is not null")  # no path is longer than the nodes


_PR_ROUNDS = 20


@query(
    "+ nodes as (select src as id from v_user union select dst from v_user), n as (select count(*)::double as n from nodes), deg as (select src, count(*) as k from v_user group by 1), "
    + "p0 as (select id, 1.0 / n as rank from nodes, n), "
    + ", ".join(
        f"p{i} as (select nodes.id, 0.15 / n + 0.85 * coalesce(sum(p.rank / deg.k), 0) as rank from nodes cross join n left join v_user e on e.dst = nodes.id left join p{i - 1} p on p.id = e.src left join deg on deg.src = e.src group by nodes.id, n)"
        for i in range(1, _PR_ROUNDS + 1)
    )
    + f" select id, round(rank, 9) as rank from p{_PR_ROUNDS}",
    "v_user",
)
def pagerank_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(d.user_graph(spark, sf), rounds=_PR_ROUNDS).select("id", F.round("rank", 9).alias("rank"))


_REACH = """+ nodes as (select src as id from v_user union select dst from v_user),
reach as (with recursive r(a, b) as (select id, id from nodes union select r.a, e.dst from r join v_user e on e.src = r.b) select * from r)
"""


@query(_REACH + "select x.a as id, min(x.b) as comp from reach x join reach y on x.a = y.b and x.b = y.a group by 1", "v_user")
def strong_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.strong_components(d.user_graph(spark, sf))


@query(
    _REACH
    + """, c as (select x.a as id, min(x.b) as comp from reach x join reach y on x.a = y.b and x.b = y.a group by 1), z as (select comp, count(*) as size from c group by 1 having count(*) > 1)
select count(*)::bigint as nontrivial, coalesce(max(size), 0)::bigint as largest, coalesce(sum(size), 0)::bigint as in_cycles from z""",
    "v_user",
)
def component_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.component_stats(graph.strong_components(d.user_graph(spark, sf)))


@query(
    """+ nodes as (select src as id from v_user union select dst from v_user), both_ as (select src, dst from v_user union select dst, src from v_user),
reach as (with recursive r(a, b) as (select id, id from nodes union select r.a, e.dst from r join both_ e on e.src = r.b) select * from r)
select a as id, min(b) as comp from reach group by 1""",
    "v_user",
)
def weak_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.weak_components(d.user_graph(spark, sf))


@query(None)
def communities(spark: SparkSession, sf: str) -> DataFrame:
    return graph.communities(d.user_graph(spark, sf))


@query(
    """select src, dst, kind, ['extracted', 'resolved', 'inferred', 'name_guess'][min(case prov when 'extracted' then 1 when 'resolved' then 2 when 'inferred' then 3 else 4 end)] as prov
from v_link where src <> dst group by src, dst, kind""",
    "v_link",
)
def edge_dedup_strongest(spark: SparkSession, sf: str) -> DataFrame:
    return graph.strongest_edges(d.links(spark, sf))


_WORD = "(^|[^A-Za-z0-9_])(be|con)($|[^A-Za-z0-9_])"
_SPEC = search.SearchSpec([_WORD], unicode=False)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.matches(d.document_files(spark, sf), _SPEC)


_HIT = f"+ hit as (select path, line, text from v_line where regexp_matches(text, '{_WORD}')) "


@query(_HIT + "select path, line::int as line, text from hit", "v_file", "v_line")
def grep_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("path", "line", "text")


@query(
    _HIT
    + "select l.path, l.line::int as line, l.text, bool_or(h.line = l.line) as hit from v_line l join hit h on h.path = l.path and h.line between l.line - 1 and l.line + 1 group by 1, 2, 3",
    "v_file", "v_line",
)
def grep_context(spark: SparkSession, sf: str) -> DataFrame:
    return search.context(d.document_files(spark, sf), _hits(spark, sf), 1, 1).select("path", "line", "text", "hit")


@query(_HIT + "select path, count(*)::bigint as matches, min(line)::int as first_line from hit group by 1", "v_file", "v_line")
def grep_files_only(spark: SparkSession, sf: str) -> DataFrame:
    return search.files_with_matches(_hits(spark, sf))


# Blocks of five lines in blocks of twenty stand for nested symbols.
_BLOCKS = """+ n as (select path, max(line) as n from v_line group by 1),
sym as (select path || ':f' || i as id, path, i * 5 + 1 as s0, i * 5 + 5 as s1, 'function' as kind from (select path, n, unnest(range(0, (n - 1) // 5 + 1)) as i from n)
  union all select path || ':c' || i, path, i * 20 + 1, i * 20 + 20, 'class' from (select path, n, unnest(range(0, (n - 1) // 20 + 1)) as i from n)
  union all select path || ':m', path, 1, n, 'module' from n),
"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = search.text_lines(d.document_files(spark, sf))
    n = lines.groupBy("path").agg(F.max("line").alias("n"))

    def cut(size: int, letter: str, kind: str) -> DataFrame:
        i = n.select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("i"))
        return i.select(
            F.concat("path", F.lit(f":{letter}"), F.col("i").cast("string")).alias("id"), "path", (F.col("i") * size + 1).alias("start_line"),
            (F.col("i") * size + size).alias("end_line"), F.lit(kind).alias("kind"),
        )

    module = n.select(F.concat("path", F.lit(":m")).alias("id"), "path", F.lit(1).alias("start_line"), F.col("n").alias("end_line"), F.lit("module").alias("kind"))
    return cut(5, "f", "function").unionByName(cut(20, "c", "class")).unionByName(module)


@query(
    _BLOCKS + _HIT[1:]
    + ", r as (select h.path, h.line, id, row_number() over (partition by h.path, h.line order by kind = 'module', s1 - s0, id) as k from hit h join sym s on s.path = h.path and h.line between s0 and s1) select path, line::int as line, id from r where k = 1",
    "v_file", "v_line",
)
def grep_enclosing(spark: SparkSession, sf: str) -> DataFrame:
    return search.enclosing(_blocks(spark, sf), _hits(spark, sf).select("path", "line")).select("path", "line", "id")


@query(
    _HIT
    + """select case when contains(path, 'src1') then 'docs' when contains(text, '|') then 'config' else 'other' end as class, count(*)::bigint as n from hit group by 1""",
    "v_file", "v_line",
)
def class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    cls = F.when(F.contains("path", F.lit("src1")), F.lit("docs")).when(F.contains("text", F.lit("|")), F.lit("config")).otherwise(F.lit("other"))
    return search.class_histogram(_hits(spark, sf).withColumn("class", cls))


@query(
    _BLOCKS
    + """h as (select doc_id as hunk_id, path, (doc_id % 9 + 1)::int as lo, (doc_id % 9 + 1 + doc_id % 4)::int as hi from v_file),
o as (select h.*, s.id, s0, s1 from h join sym s on s.path = h.path and s0 <= hi and s1 >= lo)
select hunk_id, id, greatest(lo, s0)::int as lo, least(hi, s1)::int as hi from o a where not exists (
  select 1 from o b where b.hunk_id = a.hunk_id and b.id <> a.id and b.s0 >= a.s0 and b.s1 <= a.s1 and b.s1 - b.s0 < a.s1 - a.s0)""",
    "v_file", "v_line",
)
def hunk_innermost(spark: SparkSession, sf: str) -> DataFrame:
    f = d.document_files(spark, sf)
    hunks = f.select(F.col("doc_id").alias("hunk_id"), "path", (F.col("doc_id") % 9 + 1).cast("int").alias("start_line"), (F.col("doc_id") % 4 + 1).cast("int").alias("line_count"))
    return diff.innermost(_blocks(spark, sf), hunks).select("hunk_id", "id", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))


@query(
    """select o_orderkey as diff_id, 'a' || (o_orderkey % 50) || '.py' as path, (o_orderkey % 97)::int as start_line, case when o_orderkey % 3 = 0 then 1 else (o_orderkey % 5)::int end as line_count
from orders where o_orderkey % 7 <> 0""",
)
def diff_parse(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    s = lambda c: c.cast("string")
    new = F.when(F.col("k") % 7 == 0, F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/a"), s(F.col("k") % 50), F.lit(".py")))
    count = F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(","), s(F.col("k") % 5)))
    text = F.concat_ws("\n", F.lit("--- a/x.py"), new, F.concat(F.lit("@@ -1,2 +"), s(F.col("k") % 97), count, F.lit(" @@ def f():")), F.lit("+line"))
    return diff.parse_diff(o.select(F.col("k").alias("diff_id"), text.alias("text"))).drop("seq")


@query(
    """select e.seq, max(p.seq) as last_error from v_log e left join v_log p on p.session = e.session and p.action = 'error' and p.seq < e.seq group by 1""",
    "v_log",
)
def asof_last_error(spark: SparkSession, sf: str) -> DataFrame:
    log = d.hook_log(spark, sf)
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.select("seq", F.max(F.when(F.col("action") == "error", F.col("seq"))).over(w).alias("last_error"))


_MARKED = """+ k as (select seq as answer, seq, ts, key, action as command, session % 3 as session, 10 + seq % 7 as bytes from v_log),
m as (select a.*, exists (select 1 from k b where b.session = a.session and b.key = a.key and b.command = a.command and b.seq < a.seq) as intra,
  exists (select 1 from k b where b.session = a.session and b.key = a.key and b.command <> a.command and b.seq < a.seq and b.ts between a.ts - 3600000 and a.ts) as near from k a)
"""


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    log = d.hook_log(spark, sf)
    keys = log.select(F.col("seq").alias("answer"), "seq", "ts", "key", F.col("action").alias("command"), (F.col("session") % 3).alias("session"), (F.col("seq") % 7 + 10).alias("bytes"))
    return analytics.overlaps(keys, 3_600_000)


@query(_MARKED + "select answer, intra, near and not intra as cross_ from m", "v_log")
def overlap_window(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("answer", "intra", F.col("cross").alias("cross_"))


@query(
    _MARKED
    + """select count(*)::bigint as answer_keys, count(distinct case when intra then command end)::bigint as intra_commands, count(*) filter (intra)::bigint as intra_keys,
coalesce(sum(bytes) filter (intra), 0)::bigint as intra_bytes, count(distinct case when near and not intra then answer end)::bigint as cross_answers,
count(*) filter (near and not intra)::bigint as cross_keys, coalesce(sum(bytes) filter (near and not intra), 0)::bigint as cross_bytes from m""",
    "v_log",
)
def overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.overlap_counts(_marked(spark, sf))


@query(
    "select session, count(*) filter (action = 'view' and after_)::bigint as views_after from (select *, coalesce(max(action = 'purchase') over (partition by session order by seq rows between unbounded preceding and 1 preceding), false) as after_ from v_log) group by 1",
    "v_log",
)
def first_event_flag(spark: SparkSession, sf: str) -> DataFrame:
    e = analytics.after_first(d.hook_log(spark, sf), ["session"], ["seq"], F.col("action") == "purchase")
    return e.groupBy("session").agg(F.count_if((F.col("action") == "view") & F.col("after")).alias("views_after"))


# A conversation's non-user turns as shell commands: the text's first word is what is run.
_COMMANDS = (("grep -n x src/", "localize"), ("cd /w && sed -n 1,9p a.py", "read"), ("sed -i s/a/b/ x.py", "edit"), ("(cd a; git grep -n y)", "localize"), ("/usr/bin/python3 -m pytest", "test"), ("git log --stat", "read"), ("echo done", "other"))
_TURNS = f"""+ c as (select conv_id as run, turn // 2 as turn, case when role = 'user' then null else ['{"', '".join(p for _, p in _COMMANDS)}'][1 + length(text) % {len(_COMMANDS)}] end as phase from conversations),
n as (select *, count(phase) over (partition by run, turn) as n from c),
w as (select run, turn, coalesce(phase, 'answer') as phase, sum(case when n > 0 then 1.0 / n else 1.0 end) as weight from n where n = 0 or phase is not null group by 1, 2, 3)
"""


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "conversations")
    command = F.get(F.array(*[F.lit(x) for x, _ in _COMMANDS]), F.length("text") % len(_COMMANDS))
    phase = F.when(F.col("role") != "user", analytics.call_phase(F.lit("Bash"), command))
    return analytics.turn_phases(c.select(F.col("conv_id").alias("run_id"), F.floor(F.col("turn") / 2).alias("turn"), phase.alias("phase")))


_SUMS = ", ".join(f"round(coalesce(sum(weight) filter (phase = '{p}'), 0)::double, 6) as {p}" for p in analytics.PHASES)


@query(
    _TURNS
    + f""", f as (select run, min(turn) as first_edit from w where phase = 'edit' group by 1)
select run, count(distinct turn)::bigint as turns, count(distinct case when first_edit is null or turn < first_edit then turn end)::bigint as turns_before_first_edit,
{_SUMS} from w left join f using (run) group by run""",
    "v_user",
)
def phase_split(spark: SparkSession, sf: str) -> DataFrame:
    r = analytics.run_phases(_turns(spark, sf))
    return r.select(F.col("run_id").alias("run"), "turns", "turns_before_first_edit", *[F.round(p, 6).alias(p) for p in analytics.PHASES])


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs: the priority is the task, the parity of the key the arm."""
    o = d.table(spark, sf, "orders")
    arm = F.when(F.col("o_orderkey") % 2 == 0, F.lit("A")).otherwise(F.lit("B"))
    return o.select(F.col("o_orderpriority").alias("task"), arm.alias("arm"), F.col("o_totalprice").alias("wall"), (F.col("o_orderstatus") == "F").alias("success"))


_RUNS = """+ r as (select o_orderpriority as task, case when o_orderkey % 2 = 0 then 'A' else 'B' end as arm, o_totalprice as wall, o_orderstatus = 'F' as success from orders),
p as (select task, arm, count(*) as n, avg(success::int) as success_rate, median(wall) as wall, min(wall) as lo, max(wall) as hi from r group by all)
"""


@query(_RUNS + "select task, arm, n::bigint as n, round(success_rate, 6) as success_rate, round(wall, 4) as wall, lo as wall_min, hi as wall_max from p", "v_user")
def task_medians(spark: SparkSession, sf: str) -> DataFrame:
    t = analytics.per_task(_runs(spark, sf), ("wall",))
    return t.select("task", "arm", "n", F.round("success_rate", 6).alias("success_rate"), F.round("wall", 4).alias("wall"), "wall_min", "wall_max")


@query(_RUNS + "select a.task, round(b.wall / a.wall, 6) as wall_r, round(b.success_rate - a.success_rate, 6) as diff from p a join p b on a.task = b.task and a.arm = 'A' and b.arm = 'B'", "v_user")
def paired_medians(spark: SparkSession, sf: str) -> DataFrame:
    p = analytics.paired(analytics.per_task(_runs(spark, sf), ("wall",)), ("wall",))
    return p.select("task", F.round("wall_r", 6).alias("wall_r"), F.round(F.col("success_rate_b") - F.col("success_rate_a"), 6).alias("diff"))


@query(
    """+ v as (select p_type as task, avg(p_retailprice) as x, row_number() over (order by p_type) - 1 as k from part group by 1), n as (select count(*) as n from v),
s as (select sample, slot, (('0x' || substr(md5('boot:' || sample || ':' || slot), 1, 8))::bigint % n) as k from range(5000) a(sample), n, lateral (select unnest(range(n)) as slot)),
q as (select sample, median(x) as s from s join v using (k) group by 1), r as (select s, row_number() over (order by s) - 1 as r, count(*) over () as m from q)
select round(min(s) filter (r = floor(0.025 * m)), 6) as low, round(min(s) filter (r = floor(0.975 * m) - 1), 6) as high from r""",
    "v_user",
)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    v = d.table(spark, sf, "part").groupBy(F.col("p_type").alias("task")).agg(F.avg("p_retailprice").alias("x"))
    return analytics.bootstrap(v, "x").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    """+ l as (select distinct source as question, 'd' || doc_id as path from documents where contains(text, 'the')),
t as (select distinct source as question, 'd' || doc_id as path from documents join labels using (doc_id) where quality = 1),
q as (select question from l union select question from t),
c as (select q.question, (select count(*) from l where l.question = q.question) as n_listed, (select count(*) from t where t.question = q.question) as n_truth,
  (select count(*) from l join t using (question, path) where l.question = q.question) as hit from q)
select question, n_listed::bigint as n_listed, n_truth::bigint as n_truth, round(case when n_truth > 0 then hit / n_truth else 1 end, 6) as recall,
round(case when n_listed > 0 then hit / n_listed else 0 end, 6) as precision from c""",
    "v_user",
)
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.table(spark, sf, "documents").select(F.col("source").alias("question"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text", "doc_id")
    listed = docs.filter(F.contains("text", F.lit("the")))
    truth = docs.join(d.table(spark, sf, "labels").filter("quality = 1"), "doc_id").select("question", "path")
    out = analytics.precision_recall(listed, truth, truth)
    return out.select("question", "n_listed", "n_truth", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(
    """+ g as (select *, case when tm - lag(tm) over (partition by session order by tm) < interval 8 hours then 0 else 1 end as fresh from v_log),
s as (select *, sum(fresh) over (partition by session order by tm rows unbounded preceding) as b from g)
select session, count(*)::bigint as events, epoch_us(min(tm)) // 1000 as first_ms, epoch_us(max(tm)) // 1000 as last_ms, count(distinct action)::int as paths from s group by session, b""",
    "v_log",
)
def session_batches(spark: SparkSession, sf: str) -> DataFrame:
    log = d.hook_log(spark, sf).select("session", F.col("at").alias("ts"), F.col("action").alias("path"))
    out = batches(log, "8 hours", ["session"])
    return out.select("session", "events", d.millis("first").alias("first_ms"), d.millis("last").alias("last_ms"), F.size("paths").alias("paths"))


# Two versions of the part catalogue: the second renames some, drops some.
_VERSIONS = """+ a as (select p_partkey as id, p_name as name, p_brand as qualified from part), b as (select p_partkey as id, case when p_partkey % 13 = 0 then p_name || '!' else p_name end as name, p_brand as qualified from part where p_partkey % 17 <> 0)
"""


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = d.table(spark, sf, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("qualified"))
    b = a.filter("id % 17 <> 0").withColumn("name", F.when(F.col("id") % 13 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return a, b


@query(_VERSIONS + "select distinct name from ((from a except all from b) union all (from b except all from a))", "v_user")
def delta_symdiff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _versions(spark, sf)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("name").distinct()


@query(_VERSIONS + "select id, name, qualified from b where id % 13 = 0 union all select id, name, qualified from a where id not in (select id from b where id % 13 = 0)", "v_user")
def incremental_merge(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _versions(spark, sf)
    return analytics.upsert(a, b.filter("id % 13 = 0"), ["id"])


@query(
    """select action, count(*)::bigint as n, list_sort(list(value))[floor((count(*) - 1) * 0.5 + 0.5)::int + 1] as p50, list_sort(list(value))[floor((count(*) - 1) * 0.95 + 0.5)::int + 1] as p95,
list_sort(list(value))[floor((count(*) - 1) * 0.99 + 0.5)::int + 1] as p99, max(value) as max, round(avg(value), 6) as mean from v_log group by 1""",
    "v_log",
)
def percentile_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_rank(d.hook_log(spark, sf), "value", ["action"], (0.5, 0.95, 0.99)).withColumn("mean", F.round("mean", 6))


@query("select p_brand, p_partkey, k::int as k from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part) where k <= 5")
def cap_topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    p = d.table(spark, sf, "part")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("p_brand", "p_partkey", "k")


@query(
    "select session, action, ts, (row_number() over (partition by session, action order by seq) - 1)::int as idx from v_log", "v_log"
)
def overload_index(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(d.hook_log(spark, sf), "idx", ["session", "action"], F.col("seq")).select("session", "action", "ts", "idx")


@query(
    """select page_id, href, case when contains(href, '://') then regexp_replace(href, '[?#].*$', '') else regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+') || href, '[?#].*$', '') end as target
from (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages)"""
)
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    p = d.page_links(spark, sf)
    full = F.when(F.contains("href", F.lit("://")), F.col("href")).otherwise(F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), F.col("href")))
    return p.select("page_id", "href", F.regexp_replace(full, "[?#].*$", "").alias("target"))


@query("select action, key, count(*)::bigint as n from v_log group by all", "v_log")
def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    return d.hook_log(spark, sf).groupBy("action", "key").agg(F.count("*").alias("n"))


@query("select seq, (row_number() over (order by seq desc))::int as n, strftime(tm, '%H:%M:%S') as clock from v_log order by seq desc limit 200", "v_log")
def log_view(spark: SparkSession, sf: str) -> DataFrame:
    newest = d.hook_log(spark, sf).orderBy(F.desc("seq")).limit(200)
    return analytics.log_numbers(newest).select("seq", "n", "clock")


@query("select id, regexp_extract(qualified, '[^.]+$') as last_ from v_symbol", "v_symbol")
def name_segments(spark: SparkSession, sf: str) -> DataFrame:
    return d.symbols(spark, sf).select("id", last_segment("qualified").alias("last_"))


@query(
    """select a.id as a, b.id as b, case when split_part(a.path, '/', 1) <> split_part(b.path, '/', 1) then 0 when split_part(a.path, '/', 2) <> split_part(b.path, '/', 2) then 1
when split_part(a.path, '/', 3) <> split_part(b.path, '/', 3) then 2 else 3 end::int as shared from v_symbol a join v_symbol b on a.start_line = b.start_line and a.id < b.id""",
    "v_symbol",
)
def path_affinity(spark: SparkSession, sf: str) -> DataFrame:
    s = d.symbols(spark, sf)
    a = s.select(F.col("id").alias("a"), F.col("path").alias("pa"), "start_line")
    b = s.select(F.col("id").alias("b"), F.col("path").alias("pb"), "start_line")
    return a.join(b, "start_line").filter("a < b").select("a", "b", shared_dirs("pa", "pb").alias("shared"))


@query(
    """select id, ceil(strlen('{"id":"' || id || '","qualified":"' || qualified || '","path":"' || path || '","start_line":' || start_line || ',"signature":null}') / 4)::bigint as tokens
from v_symbol""",
    "v_symbol",
)
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    s = d.symbols(spark, sf)
    record = F.struct("id", "qualified", "path", "start_line", F.lit(None).cast("string").alias("signature"))
    return s.select("id", estimate_tokens(record).alias("tokens"))


@query(
    """+ r as (select 'o' || o_orderkey as ref, 'm' || (o_orderkey % 40) as name, 'r' || (o_custkey % 5) || '/d' || (o_custkey % 20) || '/f' || (o_custkey % 100) as path, 'r' || (o_custkey % 5) as unit from orders),
s as (select 's' || s_suppkey as id, 'm' || (s_suppkey % 40) as name, 'r' || (s_suppkey % 5) || '/d' || (s_suppkey % 20) || '/f' || (s_suppkey % 100) as path, 'r' || (s_suppkey % 5) as unit from supplier),
j as (select ref, s.id, case when s.path = r.path then 0 when regexp_replace(s.path, '/[^/]*$', '') = regexp_replace(r.path, '/[^/]*$', '') then 1 when s.unit = r.unit then 2 else 3 end as sc from r join s using (name)),
b as (select ref, min(sc) as sc from j group by 1), p as (select ref, b.sc, count(distinct id) as n, min(id) as one from j join b using (ref, sc) group by 1, 2)
select r.ref, case when n is null then 'unresolved' when n = 1 then 'resolved' else 'ambiguous' end as outcome, case when n = 1 then one end as dst, coalesce(n, 0)::bigint as candidates,
['file', 'dir', 'unit', 'repo'][sc + 1] as scope from r left join p using (ref)""",
    "v_user",
)
def scope_ladder(spark: SparkSession, sf: str) -> DataFrame:
    def place(key: str) -> list:
        k = F.col(key)
        s = lambda n: (k % n).cast("string")
        unit = F.concat(F.lit("r"), s(5))
        return [F.concat(unit, F.lit("/d"), s(20), F.lit("/f"), s(100)).alias("path"), unit.alias("unit")]

    name = lambda key: F.concat(F.lit("m"), (F.col(key) % 40).cast("string")).alias("name")
    refs = d.table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("ref"), name("o_orderkey"), *place("o_custkey"))
    defs = d.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), name("s_suppkey"), *place("s_suppkey"))
    return ladder.ladder(refs, defs)


@query(
    """+ c as (select conv_id as run, turn, turn + 1 as lo, turn + 3 as hi, 'f' || (conv_id % 5) as path from conversations where role = 'assistant'),
u as (select conv_id as run, turn, turn + 2 as line, 'f' || (conv_id % 5) as path from conversations where role = 'user')
select u.run, u.path, u.line, min(c.turn) as first_read from u join c on c.run = u.run and c.path = u.path and c.turn > u.turn and u.line between c.lo and c.hi group by 1, 2, 3""",
    "v_user",
)
def read_after_definition(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "conversations")
    path = F.concat(F.lit("f"), (F.col("conv_id") % 5).cast("string")).alias("path")
    reads = c.filter("role = 'assistant'").select(F.col("conv_id").alias("run"), "turn", (F.col("turn") + 1).alias("lo"), (F.col("turn") + 3).alias("hi"), path)
    defs = c.filter("role = 'user'").select(F.col("conv_id").alias("run"), "turn", (F.col("turn") + 2).alias("line"), path)
    return analytics.read_after_definition(reads, defs)


@query(
    "select regexp_replace(path, '/[^/]*$', '') as dir, count(*)::bigint as files, sum(strlen(text))::bigint as bytes from v_file group by 1", "v_file"
)
def directory_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return d.document_files(spark, sf).groupBy(dirname("path").alias("dir")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@query("select id, qualified as local_ from v_symbol", "v_symbol")
def local_names(spark: SparkSession, sf: str) -> DataFrame:
    return d.symbols(spark, sf).select("id", local_name("qualified", F.lit("other.py")).alias("local_"))
