"""The layered benchmark graph, reach, target picking and communities against plain Python."""

from collections import Counter

from depscape.operators.graph import communities, modularity
from depscape.operators.reach import blast_order, ranked_targets, reach_counts
from depscape.operators.traverse import blast_radius
from depscape.sources.layered import LayeredGraph, layered_graph


def _reach(edges, target, most):
    seen, front = {target}, {target}
    for _ in range(most):
        front = {s for s, d in edges if d in front} - seen
        seen |= front
    return len(seen) - 1


def test_published_sizes_and_reaches(spark):
    assert sum(len(f) for f in LayeredGraph(5_000)) == 240_465
    links = layered_graph(spark, "small").cache()
    assert links.count() == 23_904
    targets = spark.createDataFrame([(4539,), (4005,), (2363,)], "target int")
    got = {r["target"]: (r["d3"], r["d10"]) for r in reach_counts(links, targets, whole=False, kinds=None).collect()}
    assert got == {4539: (104, 4987), 4005: (302, 4987), 2363: (23, 252)}
    sure = links.filter("prov = 'extracted' or resolved")
    got = {r["target"]: r["d10"] for r in reach_counts(sure, targets, whole=False, kinds=None).collect()}
    assert got == {4539: 4936, 4005: 4936, 2363: 244}
    links.unpersist()


def test_next_version_of_a_file_differs():
    g = LayeredGraph(60)
    assert g.file_edges(55) != g.file_edges(55)
    assert all(s // 10 == 55 and s != d and 0 <= d < 600 for s, d, *_ in g.file_edges(55))


def test_reach_and_roles(spark):
    edges = [(f"n{a}", f"n{b}") for a, b in [(1, 0), (2, 1), (3, 2), (4, 3), (5, 0), (6, 0), (0, 6), (7, 7)]]
    links = spark.createDataFrame([(s, d, "calls", "extracted") for s, d in edges], "src string, dst string, kind string, prov string")
    nodes = sorted({x for e in edges for x in e}) + ["alone"]
    targets = spark.createDataFrame([(n,) for n in nodes], "target string")
    got = reach_counts(links, targets, depths=(1, 2))
    want = {n: (_reach(edges, n, 1), _reach(edges, n, 2), _reach(edges, n, 99)) for n in nodes}
    assert {r["target"]: (r["d1"], r["d2"], r["whole"]) for r in got.collect()} == want
    order = sorted((w[2], n) for n, w in want.items() if w[2])
    at = lambda share: order[int((len(order) - 1) * share + 0.5)]
    assert {(r["role"], r["reach"], r["target"]) for r in ranked_targets(got, "whole").collect()} == {("hub", *order[-1]), ("p99", *at(0.99)), ("median", *at(0.5))}
    assert not ranked_targets(got.limit(0), "whole").collect()
    ranks = blast_order(blast_radius(links, targets.filter("target = 'n0'"), None)).orderBy("rank").collect()
    assert [(r["rank"], r["depth"], r["id"]) for r in ranks] == [(1, 1, "n1"), (2, 1, "n5"), (3, 1, "n6"), (4, 2, "n2"), (5, 3, "n3"), (6, 4, "n4")]


def test_communities_are_louvain(spark):
    groups = [range(k * 6, k * 6 + 6) for k in range(5)]
    inside = [(a, b) for g in groups for a in g for b in g if a < b]
    ring = [(k * 6, (k * 6 + 6) % 30) for k in range(5)]
    edges = spark.createDataFrame(inside + ring + [(40, 40)], "src long, dst long")
    label = {r["id"]: r["community"] for r in communities(edges).collect()}
    assert label == {n: n // 6 * 6 for n in range(30)} | {40: 40}
    both = inside + ring
    degree = Counter(x for e in both for x in e)
    m = len(both)
    want = sum(1 for a, b in both if label[a] == label[b]) / m - sum(sum(d for n, d in degree.items() if label[n] == c) ** 2 for c in set(label.values())) / (2 * m) ** 2
    weights = spark.createDataFrame([(*e, 1.0) for a, b in both for e in ((a, b), (b, a))], "src long, dst long, w double")
    assert abs(modularity(weights, communities(edges)) - want) < 1e-9
    assert not communities(edges.limit(0)).collect()
