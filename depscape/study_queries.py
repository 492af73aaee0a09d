"""Registered queries of reach, transcripts, replays, commits and reports, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import dirname, from_hex, nearest_folder, short_label, suffixed, to_hex
from .model import DEPENDENCY_KINDS
from .operators import reach, studies, transcripts, traverse
from .queries import _BLAST, _COMMANDS, _targets, _views, query
from .sources import driver_tables as d
from .sources.layered import layered_graph as layered

# --- reach ---

_KINDS = "(" + ", ".join(f"'{k}'" for k in DEPENDENCY_KINDS) + ")"
_REACH = f"""with recursive {_views("v_symbol", "v_link")},
e as (select distinct src, dst from v_link where kind in {_KINDS}), t as (select distinct id as target from v_symbol),
r(target, id, depth) as (select target, target, 0 from t union select r.target, e.src, r.depth + 1 from r join e on e.dst = r.id where r.depth < 12),
m as (select target, id, min(depth) as depth from r where id <> target group by all),
n as (select target, count(id) filter (depth <= 3)::bigint as d3, count(id) filter (depth <= 10)::bigint as d10, count(id)::bigint as whole from t left join m using (target) group by 1)
"""


def _reach(spark: SparkSession, sf: str) -> DataFrame:
    return reach.reach_counts(d.links(spark, sf), d.symbols(spark, sf).select(F.col("id").alias("target")))


@query(_REACH + "select * from n")
def all_targets_reach(spark: SparkSession, sf: str) -> DataFrame:
    return _reach(spark, sf)


@query(
    _REACH
    + """, o as (select target, d10, row_number() over (order by d10, target) - 1 as k, count(*) over () - 1 as last from n where d10 > 0)
select role, target, d10 as reach from o join (values ('hub', 1.0), ('p99', 0.99), ('median', 0.5)) as s(role, share) on k = floor(last * share::double + 0.5)"""
)
def benchmark_targets(spark: SparkSession, sf: str) -> DataFrame:
    return reach.ranked_targets(_reach(spark, sf))


@query(_BLAST + "select target, id, depth, (row_number() over (partition by target order by depth, id))::int as rank from r", "v_link")
def blast_order(spark: SparkSession, sf: str) -> DataFrame:
    return reach.blast_order(traverse.blast_radius(d.links(spark, sf), _targets(spark)))


@query(None)
def layered_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's small graph; its published sizes and reaches are tested."""
    return layered(spark, "small")


# --- transcripts ---


def _json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts: what isn't the user's turn is a shell command, every fourth turn a helper's; the
    user's turns are results, of which a fifth are a hook's complete answer."""
    c = d.table(spark, sf, "conversations").withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    command = F.get(F.array(*[F.lit(x) for x, _ in _COMMANDS]), F.col("n") % len(_COMMANDS))
    hook = F.col("n") % 5 == 0
    call = F.struct(F.lit("tool_use").alias("type"), F.col("turn").cast("string").alias("id"), F.lit("Bash").alias("name"), F.struct(command.alias("command")).alias("input"))
    result = F.struct(
        F.lit("tool_result").alias("type"), F.lit("none").alias("tool_use_id"), hook.alias("is_error"), F.when(hook, F.lit("3 uses, COMPLETE")).otherwise(F.lit("nothing")).alias("content")
    )
    event = lambda kind, block, nested: F.to_json(
        F.struct(
            F.lit(kind).alias("type"), nested.alias("parent_tool_use_id"),
            F.struct(F.concat(F.lit("m"), F.floor(F.col("turn") / 2).cast("string")).alias("id"), F.array(block).alias("content")).alias("message"),
        )
    )
    nested = F.when(F.col("turn") % 4 == 3, F.lit("t"))
    line = F.when(F.col("role") == "user", event("user", result, F.lit(None).cast("string"))).otherwise(event("assistant", call, nested))
    return c.select(F.col("conv_id").cast("string").alias("run"), F.col("turn").alias("seq"), line.alias("line"))


@query(
    f"""with c as (select conv_id::varchar as run, turn, role, coalesce(length(text), 0) as n from conversations),
k as (select run, turn, n % {len(_COMMANDS)} as cmd, turn % 4 = 3 as nested, row_number() over (partition by run order by turn) as call from c where role <> 'user'),
a as (select run, min(turn) as done, count(*) as hooks from c where role = 'user' and n % 5 = 0 group by 1),
p as (select k.run, count(distinct turn // 2) filter (not nested) as trips, count(*) as calls, count(*) filter (nested) as sub, min(call) filter (cmd = 2) - 1 as before,
  count(*) filter (not nested and cmd in (0, 3) and turn > done) as after_ from k left join a on a.run = k.run group by 1)
select run, coalesce(trips, 0)::bigint as round_trips, coalesce(calls, 0)::bigint as tool_calls, coalesce(sub, 0)::bigint as subagent_calls, before::int as calls_before_first_edit,
done is not null as complete, case when done is not null then coalesce(after_, 0) end::bigint as searches_after_complete, coalesce(hooks, 0)::bigint as hook_answers
from (select distinct run from c) left join p using (run) left join a using (run)"""
)
def transcript_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = transcripts.transcript_metrics(_json_lines(spark, sf))
    return m.select("run", "round_trips", "tool_calls", "subagent_calls", "calls_before_first_edit", "complete", "searches_after_complete", "hook_answers")


@query(
    """with t as (select 'd/' || c_custkey || '.py' as p, 's ' || c_custkey as f, c_custkey from customer)
select c_custkey, case when p = f then [p] else list_sort([p, f]) end::varchar as paths from t"""
)
def json_key_paths(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    inner = F.struct(F.concat(F.lit("s "), k).alias("file"), F.lit('"path": "x"').alias("note"))
    text = F.to_json(F.struct(F.array(inner).alias("items"), F.concat(F.lit("d/"), k, F.lit(".py")).alias("path"), F.lit(1).alias("n")))
    return c.select("c_custkey", F.concat(F.lit("["), F.array_join(transcripts.json_paths(text), ", "), F.lit("]")).alias("paths"))


# --- replays and commits ---


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as decisions, their lines as searches."""
    o, line = d.table(spark, sf, "orders"), d.table(spark, sf, "lineitem")
    s = F.struct(F.col("l_linenumber").cast("int").alias("sites"), (F.col("l_linenumber") % 2).cast("int").alias("lost"), (F.col("l_returnflag") == "A").alias("header_ok"))
    searches = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(s).alias("searches"))
    out = o.join(searches, "o_orderkey", "left")
    return out.select(
        F.col("o_orderpriority").alias("build"), (F.col("o_orderstatus") != "F").alias("rewrite"), F.col("o_orderstatus").alias("reason"), F.col("o_custkey").alias("hook_bytes"),
        F.col("o_orderkey").alias("plain_bytes"), (F.col("o_orderkey") % 3).alias("hook_code"), (F.col("o_custkey") % 3).alias("plain_code"), "searches",
    )


@query(
    """with s as (select l_orderkey, count(*) as n, sum(l_linenumber) as sites, sum(l_linenumber % 2) as lost, count(*) filter (l_returnflag <> 'A') as no_header from lineitem group by 1),
o as (select *, o_orderstatus <> 'F' as rw from orders left join s on l_orderkey = o_orderkey)
select o_orderpriority as build, count(*) filter (rw)::bigint as rewritten, count(*) filter (not rw)::bigint as passed, coalesce(sum(o_custkey) filter (rw), 0)::bigint as hook_bytes,
coalesce(sum(o_orderkey) filter (rw), 0)::bigint as plain_bytes, count(*) filter (rw and o_orderkey % 3 <> o_custkey % 3)::bigint as mismatches, coalesce(sum(n) filter (rw), 0)::bigint as searches,
coalesce(sum(sites) filter (rw), 0)::bigint as sites, coalesce(sum(lost) filter (rw), 0)::bigint as lost, coalesce(sum(no_header) filter (rw), 0)::bigint as no_header,
round(coalesce(sum(o_custkey) filter (rw) / nullif(sum(o_orderkey) filter (rw), 0), 0)::double, 9) as ratio from o group by 1"""
)
def replay_report(spark: SparkSession, sf: str) -> DataFrame:
    return studies.replay_report(_decisions(spark, sf)).withColumn("ratio", F.round("ratio", 9))


@query("select o_orderpriority as build, o_orderstatus as reason, count(*)::bigint as n from orders where o_orderstatus = 'F' group by all")
def passed_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return studies.passed_reasons(_decisions(spark, sf))


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits: a line changes a signature in its supplier's file, adds another and a call."""
    name = lambda c: F.concat(F.lit("p"), (c % 4).cast("string"))
    part, supp, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("string")
    lines = F.array(
        F.concat(F.lit("+++ b/s"), supp.cast("string"), F.lit(".py")), F.concat(F.lit("-def "), name(part), F.lit("(a"), k, F.lit("):")),
        F.concat(F.lit("+async def "), name(supp), F.lit("(b"), k, F.lit("):")), F.concat(F.lit("+    x = "), name(part + supp), F.lit("(1)")),
    )
    rows = d.table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array_join(lines, "\n").alias("t")).alias("r"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n")
    return rows.groupBy(F.col("l_orderkey").cast("string").alias("sha")).agg(text.alias("diff"))


@query(
    """with l as (select l_orderkey::varchar as sha, 'p' || l_partkey % 4 as old, 'p' || l_suppkey % 4 as new, 'p' || (l_partkey + l_suppkey) % 4 as used, l_suppkey as file from lineitem),
c as (select distinct sha, old as name from l join (select distinct sha, new from l) n using (sha) where old = n.new),
k as (select sha, count(distinct file) as callers from l join c using (sha) where used = name group by 1), f as (select sha, count(distinct file) as files from l group by 1)
select sha, string_agg(name, ',' order by name) as names, any_value(files)::bigint as files, any_value(callers)::bigint as caller_files
from c join k using (sha) join f using (sha) where callers >= 2 and files <= 15 group by 1"""
)
def mined_commits(spark: SparkSession, sf: str) -> DataFrame:
    return studies.mined_commits(_diffs(spark, sf)).withColumn("names", F.array_join("names", ","))


_PART_FILE = "case when p_size % 5 = 0 then 'tests/test_' else 'lib/' end || p_partkey || '.py'"


@query(
    f"""with f as (select {_PART_FILE} as path, p_size % 5 = 0 as test, p_partkey % 6 as k from part)
select 'go' as symbol, path, role from f, lateral (select unnest(case k when 0 then ['defined_in'] when 1 then [case when test then 'test_callers' else 'callers' end]
  when 2 then ['mentioned_only'] when 3 then ['defined_in', case when test then 'test_callers' else 'callers' end] when 4 then ['mentioned_only'] else [] end) as role)"""
)
def question_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files that define, call or only mention a function, in six forms."""
    forms = ("def go(x):\n    return x\n", "x = go(1)  # go(2)\n", "'''go(1)\ngo(2)'''\n", "async def go(x):\n    return go(x)\n", "x = 1  # go(1)\n", "ergo(1)\n")
    p = d.table(spark, sf, "part")
    text = F.get(F.array(*[F.lit(x) for x in forms]), (F.col("p_partkey") % len(forms)).cast("int"))
    return studies.question_truth(p.select(F.expr(_PART_FILE).alias("path"), text.alias("text")), spark.createDataFrame([("go",)], "symbol string"))


# --- records and labels ---


@query(
    f"""with c as (select doc_id, i, ch, sum(strlen(ch)) over (partition by doc_id order by i) as upto from
  (select doc_id, i, substring(text, i, 1) as ch from (select doc_id, text, unnest(range(1, length(text) + 1)) as i from documents where strlen(text) > {studies.ANSWER_BYTES}))),
k as (select doc_id, string_agg(ch, '' order by i) as cut from c where upto <= {studies.ANSWER_BYTES} group by 1)
select doc_id, md5(coalesce(cut, text)) as cut_md5, strlen(coalesce(cut, text))::int as bytes from documents left join k using (doc_id)"""
)
def log_answer_cut(spark: SparkSession, sf: str) -> DataFrame:
    cut: Column = studies.cut_bytes(F.col("text"))
    return d.table(spark, sf, "documents").select("doc_id", F.md5(cut).alias("cut_md5"), F.octet_length(cut).alias("bytes"))


@query(
    "select id, case when kind = 'method' and contains(qualified, '.') then regexp_extract(qualified, '[^.]+\\.[^.]+$') else regexp_extract(qualified, '[^.]+$') end as label from v_symbol",
    "v_symbol",
)
def short_labels(spark: SparkSession, sf: str) -> DataFrame:
    return d.symbols(spark, sf).select("id", short_label("qualified", "kind").alias("label"))


@query(
    "select p_partkey, p_name || case when k > 1 then '~' || k else '' end as part_id from (select *, row_number() over (partition by p_name order by p_partkey) as k from part)"
)
def id_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffixed(d.table(spark, sf, "part"), "p_name", "part_id", F.col("p_partkey")).select("p_partkey", "part_id")


@query("select id, lower(hex(qualified)) as hex, qualified as back from v_symbol", "v_symbol")
def hex_codecs(spark: SparkSession, sf: str) -> DataFrame:
    h = d.symbols(spark, sf).select("id", to_hex("qualified").alias("hex"))
    return h.select("id", "hex", F.decode(from_hex("hex"), "UTF-8").alias("back"))


@query(
    """+ p as (select distinct path || '/none/x.py' as path from v_symbol), f as (select distinct regexp_replace(path, '/[^/]*$', '') as folder from v_symbol where contains(path, '/'))
select p.path, max_by(folder, length(folder)) as folder from p left join f on starts_with(p.path, folder || '/') group by 1""",
    "v_symbol",
)
def nearest_folders(spark: SparkSession, sf: str) -> DataFrame:
    s = d.symbols(spark, sf)
    return nearest_folder(s.select(F.concat("path", F.lit("/none/x.py")).alias("path")), s.select(dirname("path").alias("folder")))


@query(
    """with v as (select l_returnflag as engine, l_linestatus as size, l_suppkey as variant, max((l_partkey % 97 = 0)::int) as correct, min(l_extendedprice) as value from lineitem group by all)
select engine, size, variant::varchar as variant, value from (select *, row_number() over (partition by engine, size order by correct desc, value, variant::varchar) as k from v) where k = 1"""
)
def best_variants(spark: SparkSession, sf: str) -> DataFrame:
    line = d.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("size"), F.col("l_suppkey").cast("string").alias("variant"), "l_partkey", "l_extendedprice")
    metric = F.explode(F.array(
        F.struct(F.lit("correct").alias("metric"), F.when(F.col("l_partkey") % 97 == 0, 1.0).otherwise(0.0).alias("value")), F.struct(F.lit("time").alias("metric"), F.col("l_extendedprice").alias("value"))
    ))
    return studies.best_variants(line.select("engine", "size", "variant", metric.alias("m")).select("engine", "size", "variant", "m.*"), "time")


@query(
    """select c_custkey::varchar as run_id, coalesce(s_nationkey, c_nationkey)::int as num_turns, case when s_nationkey is not null and s_nationkey <> c_nationkey then c_nationkey end::int as turns_recounted_from
from customer left join supplier on s_suppkey = c_custkey"""
)
def recounted_turns(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("run_id"), F.col("c_nationkey").alias("num_turns"))
    s = d.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"), F.col("s_nationkey").alias("num_turns"))
    return studies.recounted(c, s)
