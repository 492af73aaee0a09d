"""Graph, text and log views over relational tables.

The tables hold no source code; these views give them the shapes the operators work on: keys become
symbols, foreign keys become dependencies, documents become files to search, events become a hook log.
Ids are strings with a letter for the table.  ``SQL`` holds the same views for any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


_SYMBOL = ("id", "kind", "name", "qualified", "path", "lang", "parent", "start_line", "end_line", "is_test")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are modules, nations classes, customers and suppliers methods, parts and orders functions;
    orders of low priority are tests."""
    t = lambda n: table(spark, sf_dir, n)
    r = t("region")
    n = t("nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # at most a few hundred nations
    place = F.concat_ws("/", "r_name", "n_name")

    def rows(df: DataFrame, letter: str, key: str, kind: str, name: Column, qualified: Column, path: Column, parent: Column, test: Column | None = None) -> DataFrame:
        return df.select(
            _id(letter, key).alias("id"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), qualified.alias("qualified"), path.alias("path"),
            F.lit("python").alias("lang"), parent.cast("string").alias("parent"), F.col(key).cast("int").alias("start_line"), F.col(key).cast("int").alias("end_line"),
            (test if test is not None else F.lit(False)).alias("is_test"),
        )

    dot = lambda *c: F.concat_ws(".", *c)
    null = F.lit(None)
    few = F.broadcast(n.select("n_nationkey", "n_name", "r_name", "n_regionkey"))
    c = t("customer").join(few, F.col("c_nationkey") == F.col("n_nationkey"))
    s = t("supplier").join(few, F.col("s_nationkey") == F.col("n_nationkey"))
    o = t("orders").join(c.select("c_custkey", "r_name", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    parts = [
        rows(r, "r", "r_regionkey", "module", F.col("r_name"), F.col("r_name"), F.col("r_name"), null),
        rows(n, "n", "n_nationkey", "class", F.col("n_name"), dot("r_name", "n_name"), place, _id("r", "n_regionkey")),
        rows(c, "c", "c_custkey", "method", F.col("c_name"), dot("r_name", "n_name", "c_name"), F.concat(place, F.lit("/customer")), _id("n", "n_nationkey")),
        rows(s, "s", "s_suppkey", "method", F.col("s_name"), dot("r_name", "n_name", "s_name"), F.concat(place, F.lit("/supplier")), _id("n", "n_nationkey")),
        rows(t("part"), "p", "p_partkey", "function", F.col("p_name"), dot(F.lit("part"), "p_brand", "p_name"), F.concat_ws("/", F.lit("part"), "p_brand"), null),
        rows(
            o, "o", "o_orderkey", "function", F.col("o_orderkey"), dot("r_name", "n_name", F.col("o_orderkey").cast("string")), F.concat(place, F.lit("/orders")), null,
            F.coalesce(F.col("o_orderpriority") == "5-LOW", F.lit(False)),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*_SYMBOL)


def links(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Foreign keys: the row that refers depends on the row referred to.  A line's return flag is its provenance.
    With ``repeats`` an import is there once a line, for those who don't count links."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem")
    prov = F.when(F.col("l_returnflag") == "A", F.lit("extracted")).when(F.col("l_returnflag") == "N", F.lit("inferred")).otherwise(F.lit("name_guess"))

    def rows(df: DataFrame, src: Column, dst: Column, kind: str, p: Column | None = None, at: Column | None = None) -> DataFrame:
        p = F.lit("extracted") if p is None else p
        at = F.lit(0) if at is None else at
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), p.alias("prov"), at.cast("int").alias("site_line"))

    at = F.col("l_linenumber")
    parts = [
        rows(t("orders"), _id("o", "o_orderkey"), _id("c", "o_custkey"), "calls"),
        rows(line, _id("o", "l_orderkey"), _id("p", "l_partkey"), "calls", prov, at),
        rows(line, _id("o", "l_orderkey"), _id("s", "l_suppkey"), "references", prov, at),
        rows(line.select("l_partkey", "l_suppkey") if repeats else line.select("l_partkey", "l_suppkey").distinct(), _id("p", "l_partkey"), _id("s", "l_suppkey"), "imports"),
        rows(t("customer"), _id("c", "c_custkey"), _id("n", "c_nationkey"), "inherits"),
        rows(t("supplier"), _id("s", "s_suppkey"), _id("n", "s_nationkey"), "inherits"),
        rows(t("nation"), _id("n", "n_nationkey"), _id("r", "n_regionkey"), "contains"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def user_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a graph of users with cycles, one edge a distinct event (as ``v_user``)."""
    e = table(spark, sf_dir, "events")
    top = e.select((F.max("user_id") + 1).alias("n"))
    e = e.filter("event_id is not null and user_id is not null")
    return e.crossJoin(F.broadcast(top)).select(F.col("user_id").alias("src"), (F.col("event_id") % F.col("n")).alias("dst")).distinct()  # top: one row


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: documents as files of their source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text", "doc_id")


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def hook_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts (ms), session, action, key, value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), millis("ts").alias("ts"), F.col("ts").alias("at"), F.col("user_id").alias("session"), F.col("event_type").alias("action"),
        F.get_json_object("props", "$.k").cast("long").alias("key"), "value",
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, href: links in pages' HTML."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


# The same views as common table expressions.
SQL = {
    "v_symbol": """
  select 'r' || r_regionkey as id, 'module' as kind, r_name as name, r_name as qualified, r_name as path, null as parent, r_regionkey::int as start_line, false as is_test from region
  union all select 'n' || n_nationkey, 'class', n_name, r_name || '.' || n_name, r_name || '/' || n_name, 'r' || n_regionkey, n_nationkey::int, false from nation join region on n_regionkey = r_regionkey
  union all select 'c' || c_custkey, 'method', c_name, r_name || '.' || n_name || '.' || c_name, r_name || '/' || n_name || '/customer', 'n' || c_nationkey, c_custkey::int, false
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select 's' || s_suppkey, 'method', s_name, r_name || '.' || n_name || '.' || s_name, r_name || '/' || n_name || '/supplier', 'n' || s_nationkey, s_suppkey::int, false
    from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select 'p' || p_partkey, 'function', p_name, 'part.' || p_brand || '.' || p_name, 'part/' || p_brand, null, p_partkey::int, false from part
  union all select 'o' || o_orderkey, 'function', o_orderkey::varchar, r_name || '.' || n_name || '.' || o_orderkey, r_name || '/' || n_name || '/orders', null, o_orderkey::int, coalesce(o_orderpriority = '5-LOW', false)
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "v_link": """
  select 'o' || o_orderkey as src, 'c' || o_custkey as dst, 'calls' as kind, 'extracted' as prov, 0 as site_line from orders
  union all select 'o' || l_orderkey, 'p' || l_partkey, 'calls', case l_returnflag when 'A' then 'extracted' when 'N' then 'inferred' else 'name_guess' end, l_linenumber from lineitem
  union all select 'o' || l_orderkey, 's' || l_suppkey, 'references', case l_returnflag when 'A' then 'extracted' when 'N' then 'inferred' else 'name_guess' end, l_linenumber from lineitem
  union all select distinct 'p' || l_partkey, 's' || l_suppkey, 'imports', 'extracted', 0 from lineitem
  union all select 'c' || c_custkey, 'n' || c_nationkey, 'inherits', 'extracted', 0 from customer
  union all select 's' || s_suppkey, 'n' || s_nationkey, 'inherits', 'extracted', 0 from supplier
  union all select 'n' || n_nationkey, 'r' || n_regionkey, 'contains', 'extracted', 0 from nation""",
    "v_user": """
  select distinct user_id as src, event_id % (select max(user_id) + 1 from events) as dst from events where event_id is not null and user_id is not null""",
    "v_file": """
  select coalesce(source, 'none') || '/' || doc_id || '.txt' as path, text, doc_id from documents""",
    "v_line": """
  select path, i as line, rtrim(l[i], chr(13)) as text from (select path, l, unnest(range(1, len(l) + 1)) as i
    from (select path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as l from v_file))""",
    "v_log": """
  select event_id as seq, epoch_us(ts) // 1000 as ts, ts as tm, user_id as session, event_type as action, (props->>'$.k')::bigint as key, value from events""",
}
