"""Steps whose tables must not grow faster than their input."""

import pytest

from depscape.operators import impact, iterate, ladder, reach, resolve, traverse


@pytest.fixture
def kept_rows(monkeypatch):
    """Rows of each table that an operator keeps."""
    rows, keep = [], iterate.Steps.keep

    def counting(self, df):
        out = keep(self, df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(iterate.Steps, "keep", counting)
    return rows


def shuffled(spark, run):
    """The result of a call and the rows that its stages wrote to shuffles."""

    def stages():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        all_ = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(all_.apply(i).shuffleWriteRecords() for i in range(all_.size()))

    before = stages()
    return run(), stages() - before


def test_reach_keeps_no_pairs(spark, kept_rows):
    n = 60
    edges = [(f"s{i}", "hub") for i in range(n)] + [("hub", f"t{i}") for i in range(n)]
    links = spark.createDataFrame([(s, d, "calls", "extracted") for s, d in edges], "src string, dst string, kind string, prov string")
    targets = spark.createDataFrame([(x,) for x in ["hub", *(f"t{i}" for i in range(n))]], "target string")
    got = {tuple(r) for r in reach.reach_counts(links, targets, (1,)).collect()}
    assert got == {("hub", n, n)} | {(f"t{i}", 1, n + 1) for i in range(n)}
    assert max(kept_rows) <= 3 * n


def test_ladder_meets_one_row_a_scope(spark):
    n = 100
    refs = spark.createDataFrame([(f"r{i}", "f", "u/d/a.py", "u") for i in range(n)] + [("x", "f", "v/w/b.py", ""), ("y", None, None, None)], "ref string, name string, path string, unit string")
    defs = spark.createDataFrame([(f"d{i}", "f", f"u/e/{i}.py", "u") for i in range(n)] + [("near", "f", "v/w/c.py", "u")], "id string, name string, path string, unit string")
    got, rows = shuffled(spark, lambda: {r["ref"]: tuple(r)[1:] for r in ladder.ladder(refs, defs).collect()})
    assert got == {f"r{i}": ("ambiguous", None, n + 1, "unit") for i in range(n)} | {"x": ("resolved", "near", 1, "dir"), "y": ("unresolved", None, 0, None)}
    assert rows < 20 * n


def test_one_query_traversal_of_many_walks(spark):
    n = 101  # n ** 3 walks of three steps
    edges = [(f"n{k + 1}.{i}", f"n{k}.{j}") for k in range(3) for i in range(n) for j in range(n) if k or not j]
    links = spark.createDataFrame([(s, d, "calls", "extracted") for s, d in edges], "src string, dst string, kind string, prov string")
    targets = spark.createDataFrame([("n0.0",)], "target string")
    got = traverse.blast_radius_sql(spark, links, targets).groupBy("target", "depth").count().collect()
    assert {tuple(r) for r in got} == {("n0.0", k, n) for k in (1, 2, 3)}
    more = [(f"m{i}", f"n3.{j}") for i in range(n) for j in range(n)]
    links = links.unionByName(spark.createDataFrame([(s, d, "calls", "extracted") for s, d in more], "src string, dst string, kind string, prov string"))
    assert traverse.blast_radius_sql(spark, links, targets, 4).filter("depth = 4").count() == n


def _many_of_a_name(spark, n):
    """n functions m.f at as many paths, and n references to f by import, by receiver and by name; one import is beside a definition."""
    symbols = [(f"d{i}", "f", "python", "function", f"u/{i}/m.py", None, "m.f") for i in range(n)]
    edges = [(f"c/{i}.py", k, "python", f"s{i}", "calls", 1, None, "f", "f", q, p, "extracted") for i in range(n) for k, (q, p) in enumerate([(None, "m.f"), ("m", None), (None, None)])]
    edges += [("u/7/x.py", 0, "python", "d7", "calls", 1, None, "f", "f", None, "m.f", "extracted"), ("u/7/x.py", 1, "python", "d7", "calls", 1, None, "f", "f", None, None, "extracted")]
    edges += [("u/7/x.py", 2, "python", "d7", "calls", 1, "d3", None, None, None, None, "extracted"), ("u/7/x.py", 3, "python", "d7", "calls", 1, "gone", None, None, None, None, "extracted")]
    return (
        spark.createDataFrame(symbols, "id string, name string, lang string, kind string, path string, parent string, qualified string"),
        spark.createDataFrame(edges, "path string, idx int, lang string, src string, kind string, site_line int, dst_id string, name string, key_name string, qualifier string, import_path string, prov string"),
    )


def test_resolution_counts_before_edges_meet_candidates(spark):
    n = 80
    symbols, edges = _many_of_a_name(spark, n)
    got, rows = shuffled(spark, lambda: {(r["path"], r["idx"]): (r["outcome"], r["dst"], r["provenance"], r["candidates"]) for r in resolve.resolve(symbols, edges).collect()})
    many, none = ("ambiguous", None, None, n), ("unresolved", None, None, None)
    want = {(f"c/{i}.py", k): many for i in range(n) for k in range(3)}
    want |= {("u/7/x.py", 0): ("resolved", "d7", "resolved", None), ("u/7/x.py", 1): many, ("u/7/x.py", 2): ("resolved", "d3", "extracted", None), ("u/7/x.py", 3): none}
    assert got == want
    assert rows < 60 * n


def test_gaps_are_totals_of_a_name_less_a_targets_own(spark):
    n = 80
    symbols, edges = _many_of_a_name(spark, n)
    resolution = resolve.resolve(symbols, edges).cache()
    resolution.count()
    targets = symbols.select(symbols["id"].alias("query"), "id", "name")
    got, rows = shuffled(spark, lambda: {r["query"]: (r["ambiguous"], r["unresolved"]) for r in impact.name_gaps(resolution, edges, targets).collect()})
    assert got == {f"d{i}": (3 * n + (i != 7), 0) for i in range(n)}
    assert rows < 20 * n


def _star(spark, n):
    """n callers of one target, each called by another; half of them are tests."""
    edges = [(f"a{i:03}", "t", "calls", p, 0) for i in range(n) for p in ("name_guess", "extracted")] + [(f"b{i:03}", f"a{i:03}", "calls", "inferred", 0) for i in range(n)]
    ids = ["t", *(f"{c}{i:03}" for c in "ab" for i in range(n))]
    symbols = [(x, f"q.{x}", "function", f"d{x[0]}/f.py", 1, 1, "", x[-1] in "13579") for x in ids]
    return (
        spark.createDataFrame(edges, "src string, dst string, kind string, prov string, site_line int"),
        spark.createDataFrame(symbols, "id string, qualified string, kind string, path string, start_line int, end_line int, signature string, is_test boolean"),
    )


def test_ranks_and_groups_of_a_query_that_reaches_most(spark, monkeypatch):
    n = 40
    links, symbols = _star(spark, n)
    for most in (0, 100_000):  # joined by shuffles, by broadcasts
        monkeypatch.setattr(traverse, "_BROADCAST_ROWS", most)
        reached, _ = traverse.dependents(links, spark.createDataFrame([("t", "t")], "query string, id string"))
        assert {(r["id"], r["depth"], r["path_conf"]) for r in reached.collect()} == {(f"{c}{i:03}", d, d - 1) for c, d in (("a", 1), ("b", 2)) for i in range(n)}
    order = [f"{c}{i:03}" for c in "ab" for test in (0, 1) for i in range(test, n, 2)]
    ranked = impact.ranked_dependents(reached, symbols, links)
    assert [(r["id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [(x, k + 1) for k, x in enumerate(order)]
    assert "Window" not in ranked._jdf.queryExecution().optimizedPlan().toString()  # no task sorts a query's dependents
    for dependents in (ranked, impact.described_dependents(reached, symbols, links)):
        got = {r["path"]: (r["count"], r["prod"], r["names"], r["omitted"]) for r in impact.by_file(dependents).collect()}
        assert got == {f"d{c}/f.py": (n, n // 2, [f"q.{c}{i:03}" for i in range(0, 20, 2)], n - 10) for c in "ab"}
        assert [tuple(r)[:4] for r in impact.indirect_groups(dependents).collect()] == [("t", "db", n, n // 2)]
    assert "WindowGroupLimit" in impact.by_file(dependents)._jdf.queryExecution().optimizedPlan().toString()
