"""Graph algorithms over an edge table (src, dst), iterated as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import Steps, is_empty


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def shortest_path(edges: DataFrame, pairs: DataFrame, max_hops: int = 30) -> DataFrame:
    """src, dst, hops: least number of edges from each src to its dst (0 for itself), null if none within
    ``max_hops``.  Searches from all sources at once and stops a pair when it is found."""
    steps = Steps(edges.sparkSession, "path")
    e = steps.keep(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
    pairs = pairs.select("src", "dst").distinct()
    seen = steps.keep(pairs.select("src").distinct().select("src", F.col("src").alias("at"), F.lit(0).alias("hops")))
    front, hops = seen, 0
    open_ = steps.keep(pairs.filter("src <> dst"))
    while hops < max_hops and not is_empty(open_):
        hops += 1
        live = front.join(open_.select("src").distinct(), "src", "left_semi")
        step = live.join(e, live["at"] == e["u"]).select("src", F.col("v").alias("at")).distinct()
        front = steps.keep(step.join(seen, ["src", "at"], "left_anti").withColumn("hops", F.lit(hops)))
        if is_empty(front):
            break
        seen = steps.union(seen, front)
        open_ = steps.keep(open_.join(front.select("src", F.col("at").alias("dst")), ["src", "dst"], "left_anti"))
    return pairs.join(seen.select("src", F.col("at").alias("dst"), "hops"), ["src", "dst"], "left").select("src", "dst", "hops")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """id, rank: from equal ranks; every edge, parallel ones too, carries a share; what nodes without edges
    hold is dropped."""
    steps = Steps(edges.sparkSession, "pagerank")
    ids = steps.keep((nodes if nodes is not None else nodes_of(edges)).select("id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    e = steps.keep(edges.groupBy("src", "dst").agg(F.count("*").alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("deg")).alias("share")))
    rank = ids.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        flow = e.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = steps.keep(ids.join(flow, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
        steps.release(rank)
        rank = new
    return rank


def weak_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, comp: the least id a node is connected to, edges taken both ways; labels spread and jump."""
    steps = Steps(edges.sparkSession, "components")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    both = steps.keep(both)
    ids = nodes_of(edges) if nodes is None else nodes.select("id").distinct()
    label = steps.keep(ids.withColumn("comp", F.col("id")))
    while True:
        near = both.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("comp").alias("near"))
        low = label.join(near, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        low = steps.keep(low)
        jump = low.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        new = steps.keep(low.join(jump, "comp", "left").select("id", "old", F.coalesce("next", "comp").alias("comp")))
        steps.release(low, label)
        if is_empty(new.filter("comp <> old")):
            return new.select("id", "comp")
        label = steps.keep(new.select("id", "comp"))
        steps.release(new)


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, comp: the least id of a node's strongly connected component.

    Each round trims nodes without edges in or out, colours every node with the least id that reaches it,
    and takes as a component what a colour's own node reaches backwards within the colour."""
    steps = Steps(edges.sparkSession, "scc")
    ids = steps.keep(nodes_of(edges) if nodes is None else nodes.select("id").distinct())
    e = steps.keep(edges.filter("src <> dst").select("src", "dst").distinct())
    done: list[DataFrame] = []
    live = ids
    while True:
        while True:  # a node without edges in, or out, is a component by itself
            keep = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            keep = steps.keep(keep.join(live, "id", "left_semi"))
            gone = steps.keep(live.join(keep, "id", "left_anti"))
            if is_empty(gone):
                break
            done.append(gone.withColumn("comp", F.col("id")))
            live = keep
            alive = keep.select(F.col("id").alias("src"))
            e = steps.keep(e.join(alive, "src", "left_semi").join(alive.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
        if is_empty(live):
            break
        colour = steps.keep(live.withColumn("c", F.col("id")))
        while True:
            into = e.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = steps.keep(colour.join(into, "id", "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")))
            steps.release(colour)
            if is_empty(new.filter("c <> old")):
                colour = new.select("id", "c")
                break
            colour = steps.keep(new.select("id", "c"))
            steps.release(new)
        within = e.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        within = steps.keep(within)
        found = steps.keep(colour.filter("id = c"))
        front = found
        while True:
            back = front.withColumnRenamed("id", "dst").join(within, ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            front = steps.keep(back.join(found, "id", "left_anti"))
            if is_empty(front):
                break
            found = steps.union(found, front)
        done.append(found.select("id", F.col("c").alias("comp")))
        live = steps.keep(live.join(found, "id", "left_anti"))
        alive = live.select(F.col("id").alias("src"))
        e = steps.keep(e.join(alive, "src", "left_semi").join(alive.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("comp").agg(F.count("*").alias("size"))


def component_stats(components: DataFrame) -> DataFrame:
    """nontrivial, largest, in_cycles over components of more than one node."""
    big = component_sizes(components).filter("size > 1")
    return big.agg(F.count("*").alias("nontrivial"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.coalesce(F.sum("size"), F.lit(0)).alias("in_cycles"))


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community: synchronous label propagation from single nodes; the commonest label around a node and
    on itself wins, the least of equals.  Half of the nodes, by a hash, move in a round, so labels don't
    swap back and forth."""
    steps = Steps(edges.sparkSession, "communities")
    both = steps.keep(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct())
    label = steps.keep(nodes_of(edges).withColumn("community", F.col("id")))
    for k in range(rounds):
        votes = both.join(label.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "community")
        votes = votes.unionByName(label).groupBy("id", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b"))
        moves = F.pmod(F.xxhash64("id"), F.lit(2)) == k % 2
        new = label.join(best, "id").select("id", F.col("community").alias("old"), F.when(moves, F.col("b.community")).otherwise(F.col("community")).alias("community"))
        new = steps.keep(new)
        still = is_empty(new.filter("old <> community"))
        steps.release(label)
        label = steps.keep(new.select("id", "community"))
        steps.release(new)
        if still and k:
            break
    return label


def modularity(weights: DataFrame, label: DataFrame) -> float:
    """Modularity of communities (id, community) on symmetric weights (src, dst, w; loops hold both their ends)."""
    at = label.select(F.col("id").alias("src"), F.col("community").alias("cs"))
    to = label.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    per = weights.join(at, "src").join(to, "dst").groupBy("cs").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"))
    r = per.agg(F.sum("inside").alias("inside"), F.sum(F.col("all") * F.col("all")).alias("squares"), F.sum("all").alias("all")).first()
    return r["inside"] / r["all"] - r["squares"] / r["all"] ** 2 if r["all"] else 0.0


def communities(edges: DataFrame, rounds: int = 8, levels: int = 6) -> DataFrame:
    """id, community: Louvain communities of the graph, edges unweighted and taken both ways.

    A level starts from single nodes.  In a round, half of the nodes (by a hash of id and round) move to the
    neighbouring community that gains most modularity, the least of equals; the other half stays, so that
    neighbours seldom swap.  When nothing moves, or after ``rounds``, each community becomes one node of the next
    level, if the level raised the modularity.  A community is named by the least id in it."""
    steps = Steps(edges.sparkSession, "louvain")
    pairs = edges.filter("src is not null and dst is not null").select("src", "dst").distinct()
    own = steps.keep(nodes_of(pairs).withColumn("community", F.col("id")))
    both = pairs.filter("src <> dst")
    weights = steps.keep(both.union(both.select("dst", "src")).distinct().withColumn("w", F.lit(1.0)))
    total = weights.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    best, score = own, modularity(weights, own)
    for level in range(levels if total else 0):
        degree = steps.keep(weights.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
        label = steps.keep(degree.select("id", F.col("id").alias("community")))
        between = weights.filter("src <> dst")
        for k in range(rounds):
            held = label.join(degree, "id").groupBy("community").agg(F.sum("k").alias("held"))
            near = between.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("w"))
            stay = label.select("id", "community", F.lit(0.0).alias("w"))
            ways = near.unionByName(stay).groupBy("id", "community").agg(F.sum("w").alias("w")).join(held, "community").join(degree, "id")
            ways = ways.join(label.select("id", F.col("community").alias("old")), "id")
            others = F.col("held") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("w") - F.col("k") * others / F.lit(total), 9)
            pick = F.min(F.struct((-gain).alias("gain"), (F.col("community") != F.col("old")).alias("moves"), "community")).alias("p")
            free = F.pmod(F.xxhash64("id", F.lit(k + level)), F.lit(2)) == 0
            new = ways.groupBy("id", "old").agg(pick).select("id", "old", F.when(free, F.col("p.community")).otherwise(F.col("old")).alias("community"), F.col("p.moves").alias("wants"))
            new = steps.keep(new)
            steps.release(label)
            settled = is_empty(new.filter("wants"))
            label = steps.keep(new.select("id", "community"))
            steps.release(new)
            if settled:
                break
        least = label.groupBy("community").agg(F.min("id").alias("least"))
        label = steps.keep(label.join(least, "community").select("id", F.col("least").alias("community")))
        mapped = own.join(label.select(F.col("id").alias("community"), F.col("community").alias("up")), "community", "left")
        own = steps.keep(mapped.select("id", F.coalesce("up", "community").alias("community")))
        to = label.select(F.col("id").alias("dst"), F.col("community").alias("d"))
        joined = weights.join(label.select(F.col("id").alias("src"), F.col("community").alias("s")), "src").join(to, "dst")
        merged = steps.keep(joined.groupBy("s", "d").agg(F.sum("w").alias("w")).select(F.col("s").alias("src"), F.col("d").alias("dst"), "w"))
        steps.release(weights, degree, label)
        weights = merged
        now = modularity(weights, weights.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
        if now <= score + 1e-9:
            break
        best, score = own, now
    return best


def strongest_edges(edges: DataFrame) -> DataFrame:
    """src, dst, kind, prov: one edge for each (src, dst, kind), of the strongest provenance; no self loops."""
    from ..model import PROVENANCES, from_ordinal, ordinal

    best = F.min(ordinal(F.col("prov"), PROVENANCES)).alias("p")
    return edges.filter("src <> dst").groupBy("src", "dst", "kind").agg(best).select("src", "dst", "kind", from_ordinal(F.col("p"), PROVENANCES).alias("prov"))


def shape(symbols: DataFrame, links: DataFrame, hubs: int = 20) -> dict[str, DataFrame]:
    """Counts by kind, language and provenance, the fan-in distribution and the top hubs."""
    fan = in_degree(links)
    everyone = symbols.select("id", "qualified").join(fan, "id", "left").select("id", "qualified", F.coalesce("n", F.lit(0)).alias("fan_in"))
    return {
        "symbol_kinds": symbols.groupBy("lang", "kind").agg(F.count("*").alias("n")),
        "edge_kinds": links.groupBy("kind", "prov").agg(F.count("*").alias("n")),
        "fan_in": everyone.groupBy("fan_in").agg(F.count("*").alias("n")),
        "hubs": everyone.orderBy(F.desc("fan_in"), "id").limit(hubs),
    }
