"""Whole-job queries against brute force on small tables."""

import pytest

from depscape.queries import ORACLE, QUERIES

EVENTS = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (0, 1), (6, 7), (8, 8), (9, 6), (0, 31)]  # user, event_id


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('events')}"
    spark.createDataFrame(EVENTS, "user_id long, event_id long").write.parquet(f"{folder}/events.parquet")
    return folder


def test_graph_algorithms_see_every_event(spark, events_dir):
    edges = {(u, e % (max(u for u, _ in EVENTS) + 1)) for u, e in EVENTS}
    nodes = sorted({x for e in edges for x in e})
    reach = {a: {a: 0} for a in nodes}  # hops by breadth-first search
    for a in nodes:
        front = [a]
        for u in front:  # grows
            for v in sorted(v for s, v in edges if s == u and v not in reach[a]):
                reach[a][v] = reach[a][u] + 1
                front.append(v)
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, events_dir).collect()]
    assert sorted(run("shortest_paths")) == sorted((0, b, h) for b, h in reach[0].items())
    strong = {a: min(b for b in reach[a] if a in reach[b]) for a in nodes}
    assert dict(run("strong_components")) == strong
    sizes = [n for n in (list(strong.values()).count(c) for c in set(strong.values())) if n > 1]
    assert run("component_stats") == [(len(sizes), max(sizes), sum(sizes))]
    weak = {a: a for a in nodes}
    for _ in nodes:
        for a, b in edges:
            weak[a] = weak[b] = min(weak[a], weak[b])
    assert dict(run("weak_components")) == weak
    rank = {a: 1 / len(nodes) for a in nodes}
    for _ in range(20):
        rank = {b: 0.15 / len(nodes) + 0.85 * sum(rank[u] / sum(x == u for x, _ in edges) for u, v in edges if v == b) for b in nodes}
    assert dict(run("pagerank_rounds")) == pytest.approx(rank, abs=1e-8)
    groups = dict(run("communities"))
    assert set(groups) == set(nodes) and all(weak[a] == weak[c] for a, c in groups.items())


SF = "/root/testdata/sf0.001"


def against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as from read_parquet('{SF}/{t}.parquet')")
    want = c.execute(ORACLE[name]).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_name_gaps_of_every_part(spark):
    assert len(against_sql(spark, "name_gaps")) == spark.read.parquet(f"{SF}/part.parquet").count()


@pytest.mark.parametrize("name", ["local_names", "token_estimates", "name_segments", "called_by_top3"])
def test_queries_over_every_symbol(spark, name):
    got = against_sql(spark, name)
    assert {r[0][0] for r in got} >= ({"c", "p", "s", "n"} if name == "called_by_top3" else set("rncspo"))


@pytest.mark.parametrize(
    "name",
    ["shortest_paths", "pagerank_rounds", "strong_components", "component_stats", "weak_components", "path_affinity", "bootstrap_ci", "dependents_ranked"],
)
def test_whole_tables_against_sql(spark, name):
    assert against_sql(spark, name)
