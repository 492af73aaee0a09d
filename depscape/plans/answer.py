"""Answer documents: envelopes built from result tables, cut to a token budget, and their text form.

The tables are computed by Spark; a document takes the ranked heads of them to the driver (bounded by the
options) and discloses everything it leaves out.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import local_name, node_id
from ..model import CONFIDENCES, DEPENDENCY_KINDS
from ..operators import impact, traverse
from ..operators.diff import diff_impact
from ..operators.freshness import source_states
from ..operators.lookup import lookup

TIERS = ("full", "summary", "by_file", "by_directory")
MAX_TESTS, MAX_COVERING, MAX_CHANGED_CALLERS, MAX_COARSE_SITES = 20, 50, 30, 20


@dataclass
class Options:
    depth: int = 3
    token_budget: int = 8000
    items: int = 2000
    max_callers: int = impact.MAX_CALLERS
    kinds: tuple[str, ...] = DEPENDENCY_KINDS
    source_items: int = 12
    compact: bool = False


@dataclass
class Graph:
    """The tables a question is answered from, and the state they are in."""

    symbols: DataFrame
    links: DataFrame
    resolution: DataFrame
    raw_edges: DataFrame
    rev: int = 0
    stale: bool = False
    parse_failures: int = 0
    locals_: DataFrame | None = field(default=None, repr=False)
    read: Callable[[list[str]], DataFrame] | None = field(default=None, repr=False)  # path, content of files as they are now


def disclosure(what: str, shown: int, omitted: int, reason: str) -> dict:
    return {"what": what, "shown": shown, "omitted": omitted, "reason": reason}


def tokens(document: dict) -> int:
    """A quarter of the bytes of its JSON, rounded up."""
    return -(-len(json.dumps(document, ensure_ascii=False, separators=(",", ":")).encode()) // 4)


def envelope(graph: Graph, query: str, result: dict, causes: dict, cuts: list[dict]) -> dict:
    status = "lower_bound" if any(v for k, v in causes.items() if k != "ref_scope") else "complete"
    return {
        "schema": 1, "query": query, "graph_rev": graph.rev, "stale": graph.stale, "tier": "full",
        "completeness": {"status": status, "causes": causes}, "disclosures": list(cuts), "result": result,
    }


def _causes(graph: Graph, ambiguous: int, unresolved: int, scope: str, changed: int = 0) -> dict:
    return {"ambiguous_refs": ambiguous, "unresolved_refs": unresolved, "parse_failures": graph.parse_failures, "source_changed": changed, "ref_scope": scope}


def _changed(graph: Graph, ids: list[str]) -> int:
    """How many of a bounded list of symbols no longer stand in their files as indexed."""
    if graph.read is None or not ids:
        return 0
    s = graph.symbols.filter(F.col("id").isin(*ids))
    paths = sorted({r["path"] for r in s.select("path").distinct().collect()})
    return source_states(s, graph.read(paths)).filter("state <> 'fresh'").count()


def _view(r) -> dict:
    return {
        "id": r["id"], "qualified": r["qualified"], "kind": r["kind"], "path": r["path"], "start_line": r["start_line"], "end_line": r["end_line"],
        "signature": r["signature"], "role": "test" if r["is_test"] else "prod", "local": r["local"],
    }


def _views(graph: Graph, ids: list[str]) -> dict[str, dict]:
    """Symbols of a bounded list of ids."""
    s = graph.symbols.filter(F.col("id").isin(*ids)) if ids else graph.symbols.limit(0)
    return {r["id"]: _view(r) for r in s.withColumn("local", local_name("qualified", "path")).collect()}


# --- documents ---


def lookup_document(graph: Graph, ref: str) -> dict:
    result, cuts = _lookup(graph, ref)
    return envelope(graph, "lookup", result, _causes(graph, 0, 0, "none"), cuts)


def _lookup(graph: Graph, ref: str) -> tuple[dict, list[dict]]:
    asked = graph.symbols.sparkSession.createDataFrame([(ref,)], "ref string")
    rows = sorted(lookup(graph.symbols, asked).collect(), key=lambda r: r["rank"] or 0)
    status, n = rows[0]["status"], rows[0]["n"]
    views = _views(graph, [r["id"] for r in rows if r["id"]])
    found = [views[r["id"]] for r in rows if r["id"]]
    out = {"query": ref, "status": status, "symbol": found[0] if status == "found" else None, "candidates": found if status == "ambiguous" else []}
    cuts = [disclosure("candidates", len(found), n - len(found), f"first {len(found)} of {n} candidates")] if status == "ambiguous" and n > len(found) else []
    return out, cuts


def _dependents(graph: Graph, ranked: DataFrame, beyond: int, counts: dict, opts: Options) -> tuple[dict, list[dict]]:
    files = impact.by_file(ranked)
    dirs = impact.by_directory(files)
    depth_counts = {r["depth"]: r["n"] for r in impact.by_depth(ranked).collect()}
    head = impact.fill_lines(ranked, graph.links).filter(F.col("rank") <= opts.items).orderBy("rank").collect()
    via = _views(graph, sorted({r["via"] for r in head}))
    items = [
        {
            "symbol": _view({**r.asDict(), "kind": r["symbol_kind"], "local": None}), "depth": r["depth"], "via": via[r["via"]]["qualified"] if r["via"] in via else None,
            "edge": r["kind"], "edge_confidence": CONFIDENCES[r["edge_conf"]], "confidence": r["confidence"], "fan_in": r["fan_in"], "lines": list(r["lines"]),
        }
        for r in head
    ]
    group = lambda df, key: [
        {k: (list(v) if isinstance(v, list) else v) for k, v in r.asDict().items() if k != "query"} for r in df.orderBy("min_depth", F.desc("count"), key).limit(opts.items).collect()
    ]
    total = counts.get("total", 0)
    cuts = []
    if beyond:
        cuts.append(disclosure("depth", total, beyond, f"{beyond} dependents at depth {opts.depth} have further dependents; raise depth to see them"))
    if total > len(items):
        cuts.append(disclosure("dependents", len(items), total - len(items), f"first {len(items)} ranked dependents listed; counts cover all"))
    summary = {
        "total": total, "prod": counts.get("prod", 0), "test": counts.get("test", 0), "by_depth": [depth_counts.get(d, 0) for d in range(1, opts.depth + 1)],
        "depth_limit": opts.depth, "more_beyond_depth": beyond,
    }
    return {"summary": summary, "items": items, "by_file": group(files, "path"), "by_directory": group(dirs, "dir")}, cuts


def _indirect(ranked: DataFrame) -> dict:
    far = ranked.filter("depth >= 2 and symbol_kind <> 'module'")
    n = far.agg(F.count("*").alias("total"), F.count_if(~F.col("is_test")).alias("prod"), F.count_if("is_test").alias("test")).first()
    groups = impact.indirect_groups(ranked, 1 << 30)
    modules = groups.count()
    rows = groups.orderBy(F.desc("prod"), F.desc("count"), "module").limit(impact.MAX_INDIRECT_GROUPS).collect()
    keys = ("module", "count", "prod", "test", "min_depth")
    return {"total": n["total"], "prod": n["prod"], "test": n["test"], "modules": modules, "groups": [{**{k: r[k] for k in keys}, "top": list(r["top"])} for r in rows]}


def _tests(graph: Graph, targets: DataFrame, depth: int) -> dict:
    """Runnable tests that reach the targets, nearest first."""
    t = traverse.covering_tests(graph.links, graph.symbols, targets, depth).groupBy("id").agg(F.min("depth").alias("depth"))
    s = graph.symbols.filter(F.col("kind").isin("function", "method") & F.col("name").rlike("^test")).select("id", node_id("qualified", "path").alias("node_id"))
    t = t.join(s, "id")
    return {"total": t.count(), "depth_limit": depth, "items": [{"node_id": r["node_id"], "depth": r["depth"]} for r in t.orderBy("depth", "node_id").limit(MAX_TESTS).collect()]}


def _sites(graph: Graph, targets: DataFrame, cap: int) -> tuple[dict[str, list[dict]], dict[str, dict]]:
    """Per query: ranked call sites up to ``cap``, and counts over all."""
    sites = impact.site_rank(impact.direct_sites(graph.links, graph.symbols, targets))
    counts = {r["query"]: {k: v for k, v in r.asDict().items() if k != "query"} for r in impact.direct_summary(sites, graph.links, graph.symbols, targets).collect()}
    head = sites.filter(F.col("rank") <= cap)
    up = {r["caller"]: r for r in impact.called_by(head, graph.links, graph.symbols).collect()}
    rows = head.orderBy("query", "rank").collect()
    views = _views(graph, sorted({r["caller"] for r in rows}))
    out: dict[str, list[dict]] = {}
    for r in rows:
        u = up.get(r["caller"])
        out.setdefault(r["query"], []).append(
            {
                "caller": views[r["caller"]], "lines": list(r["lines"]), "edge": r["edge"], "confidence": CONFIDENCES[r["confidence"]],
                "called_by": list(u["called_by"]) if u else [], "called_by_total": u["called_by_total"] if u else 0,
                "called_by_prod": list(u["called_by_prod"]) if u else [], "called_by_prod_total": u["called_by_prod_total"] if u else 0,
            }
        )
    return out, counts


def _overrides(graph: Graph, methods: DataFrame) -> dict[str, list[dict]]:
    rows = traverse.overrides(graph.links, graph.symbols, methods).orderBy("id", F.col("relation") == "overrides", "path", "start_line").limit(1000).collect()
    views = _views(graph, sorted({r["other"] for r in rows}))
    out: dict[str, list[dict]] = {}
    for r in rows:
        out.setdefault(r["id"], []).append({"relation": r["relation"], "symbol": views[r["other"]]})
    return out


def blast_document(graph: Graph, ref: str, opts: Options | None = None) -> dict:
    """What depends on one symbol."""
    opts = opts or Options()
    target, cuts = _lookup(graph, ref)
    if target["status"] != "found":
        empty = {"target": target, "risk": None, "dependents": None, "direct": None, "call_sites": [], "indirect": None, "tests": None, "overrides": []}
        return envelope(graph, "blast_radius", empty, _causes(graph, 0, 0, "none"), cuts)
    spark = graph.symbols.sparkSession
    sym = target["symbol"]
    name = sym["qualified"].split(".")[-1]
    root = spark.createDataFrame([("q", sym["id"], name)], "query string, id string, name string")
    reached, beyond = traverse.dependents(graph.links, root, opts.depth, opts.kinds)
    ranked = impact.ranked_dependents(reached, graph.symbols, graph.links)
    row = impact.summary(reached, graph.symbols).first()
    counts = row.asDict() if row else {}
    dependents, more = _dependents(graph, ranked, beyond.first()["beyond"], counts, opts)
    gaps = impact.name_gaps(graph.resolution, graph.raw_edges, root, opts.kinds).first()
    sites, direct = _sites(graph, root.select("query", "id"), opts.max_callers)
    cuts += more
    shown, callers = len(sites.get("q", [])), direct["q"]["callers"]
    if callers > shown:
        cuts.append(disclosure("call_sites", shown, callers - shown, f"call sites listed for the first {shown} callers (prod first); counts cover all"))
    result = {
        "target": target, "risk": _risk(spark, counts, gaps["ambiguous"] + gaps["unresolved"]), "dependents": dependents, "direct": direct["q"],
        "call_sites": sites.get("q", []), "indirect": _indirect(ranked), "tests": _tests(graph, root.select(F.col("id").alias("target")), max(opts.depth, 3)),
        "overrides": _overrides(graph, root.select("id")).get(sym["id"], []),
    }
    listed = [sym["id"]] + [i["symbol"]["id"] for i in dependents["items"] if i["symbol"]["kind"] != "module"][: opts.source_items]
    changed = _changed(graph, list(dict.fromkeys(listed)))
    return finish(envelope(graph, "blast_radius", result, _causes(graph, gaps["ambiguous"], gaps["unresolved"], "target", changed), cuts), opts)


def _risk(spark, counts: dict, gaps: int) -> dict:
    c = {k: counts.get(k) or 0 for k in ("prod_direct", "prod_total", "test_total")}
    row = impact.assess(spark.createDataFrame([(*c.values(), gaps)], "prod_direct long, prod_total long, test_total long, gaps long")).first()
    return {"level": row["level"], **c, "reason": row["reason"]}


def diff_document(graph: Graph, hunks: DataFrame, opts: Options | None = None) -> dict:
    """What the changes of a diff (hunk_id, path, start_line, line_count) reach."""
    opts = opts or Options()
    spark = graph.symbols.sparkSession
    t = diff_impact(graph.symbols, graph.links, graph.resolution, graph.raw_edges, hunks, opts.depth)
    changed = t["changed"].orderBy("path", "start_line").collect()
    ids = [r["id"] for r in changed]
    views = _views(graph, ids)
    own = spark.createDataFrame([(i, i) for i in ids], "query string, id string")
    sites, direct = _sites(graph, own, MAX_CHANGED_CALLERS)
    over = _overrides(graph, own.select("id"))
    risk = t["risk"].first()
    counts = risk.asDict() if risk else {}
    beyond = t["beyond"].first()
    dependents, cuts = _dependents(graph, t["dependents"], beyond["beyond"] if beyond else 0, counts, opts)
    gaps = impact.name_gaps(graph.resolution, graph.raw_edges, t["changed"].select(F.col("id").alias("query"), "id", "name"), opts.kinds)
    g = gaps.agg(F.coalesce(F.sum("ambiguous"), F.lit(0)).alias("a"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("u")).first()
    covering = t["covering_tests"].orderBy("depth", "qualified").limit(MAX_COVERING + 1).collect()
    if len(covering) > MAX_COVERING:
        n = t["covering_tests"].count()
        cuts.append(disclosure("covering_tests", MAX_COVERING, n - MAX_COVERING, f"first {MAX_COVERING} of {n} covering tests"))
    cover = _views(graph, [r["id"] for r in covering[:MAX_COVERING]])
    result = {
        "changed": [
            {
                "symbol": views[r["id"]], "hunks": [[h["lo"], h["hi"]] for h in r["ranges"]], "direct_prod_callers": r["direct_prod"], "direct_test_callers": r["direct_test"],
                "reference_gaps": r["gaps"], "risk": r["risk"], "direct": direct[r["id"]], "call_sites": sites.get(r["id"], []), "overrides": over.get(r["id"], []),
            }
            for r in changed
        ],
        "unmapped": [{k: r[k] for k in ("path", "start_line", "line_count", "reason")} for r in t["unmapped"].orderBy("hunk_id").collect()],
        "risk": _risk(spark, counts, (g["a"] or 0) + (g["u"] or 0)), "dependents": dependents, "covering_tests": [cover[r["id"]] for r in covering[:MAX_COVERING]],
        "tests_basis": "changed tests and tests among the dependents", "indirect": _indirect(t["dependents"]),
        "tests": _tests(graph, own.select(F.col("id").alias("target")), max(opts.depth, 3)),
    }
    return finish(envelope(graph, "diff_impact", result, _causes(graph, g["a"] or 0, g["u"] or 0, "changed_symbols", _changed(graph, ids[: opts.items])), cuts), opts)


# --- budget ---


def _degrade(result: dict, tier: str) -> list[dict]:
    """Makes a result coarser; what went."""
    d = result["dependents"]
    cuts = []
    if tier == "by_file" and d["items"]:
        cuts.append(disclosure("dependents", 0, len(d["items"]), "tier by_file: dependents grouped by file"))
        d["items"] = []
    if tier == "by_directory":
        if d["by_file"]:
            cuts.append(disclosure("files", 0, len(d["by_file"]), "tier by_directory: files grouped by directory"))
        d["items"], d["by_file"] = [], []
        for owner, what in ((result, "call_sites"), *((c, "changed_call_sites") for c in result.get("changed", []))):
            sites = owner.get("call_sites", [])
            if len(sites) > MAX_COARSE_SITES:
                cuts.append(disclosure(what, MAX_COARSE_SITES, len(sites) - MAX_COARSE_SITES, f"tier by_directory: first {MAX_COARSE_SITES} callers"))
                owner["call_sites"] = sites[:MAX_COARSE_SITES]
    return cuts


def finish(env: dict, opts: Options) -> dict:
    """The document within its token budget: coarser tiers, then fewer directory groups, every cut disclosed."""
    if env["stale"]:
        env["disclosures"].append(disclosure("freshness", 0, 0, "index is behind the working tree; results reflect graph_rev"))
    groups = env["result"]["dependents"]
    files, dirs = groups["by_file"], groups["by_directory"]
    groups["by_file"], groups["by_directory"] = [], []
    if opts.compact:
        env["tier"] = "summary"
    for tier in TIERS[1:]:
        if TIERS.index(tier) <= TIERS.index(env["tier"]) or tokens(env) <= opts.token_budget:
            continue
        if tier == "by_file":
            groups["by_file"] = files
        if tier == "by_directory":
            groups["by_directory"] = dirs
        env["disclosures"] += _degrade(env["result"], tier)
        env["tier"] = tier
    dropped = 0
    while tokens(env) > opts.token_budget and groups["by_directory"]:
        groups["by_directory"].pop()
        dropped += 1
    if dropped:
        env["disclosures"].append(disclosure("directory groups", 0, dropped, f"token budget {opts.token_budget}: lowest-ranked directory groups dropped"))
    return env


# --- text ---

TOP_CALLERS, TOP_CHANGED_CALLERS, LINES_PER_CALLER, TOP_TESTS, TOP_GROUPS, TOP_UNMAPPED = 12, 5, 4, 5, 6, 5


def _n(count: int, one: str, many: str | None = None) -> str:
    return f"{count} {one if count == 1 else many or one + 's'}"


def _head(s: dict) -> str:
    return f"{s['signature'] or s['local']}  {s['path']}:{s['start_line']}  [{s['kind']}]"


def _lookup_lines(r: dict) -> list[str]:
    if r["status"] == "found":
        return [_head(r["symbol"]), f"qualified: {r['symbol']['qualified']}"]
    if r["status"] == "ambiguous":
        rows = [f"  {c['qualified']}  {c['path']}:{c['start_line']}  [{c['kind']}]" for c in r["candidates"]]
        return [f"AMBIGUOUS: {_n(len(rows), 'symbol')} match '{r['query']}' — pass a qualified name:", *rows]
    return [f"NOT FOUND: no indexed symbol matches '{r['query']}'"]


def _completeness_text(env: dict, name: str = "") -> str:
    c = env["completeness"]
    if c["status"] == "complete":
        return "COMPLETE"
    k, why = c["causes"], []
    open_ = " + ".join(f"{k[f'{w}_refs']} {w}" for w in ("ambiguous", "unresolved") if k[f"{w}_refs"])
    if open_:
        named = f" named `{name}`" if name else ""
        why.append(f"{open_} refs{named} could be hidden callers")
    if k["parse_failures"]:
        why.append(_n(k["parse_failures"], "file failed to parse", "files failed to parse"))
    if k["source_changed"]:
        why.append(f"{_n(k['source_changed'], 'symbol')} changed since indexing")
    return f"LOWER-BOUND ({'; '.join(why)})"


def _risk_text(r: dict | None) -> str:
    if not r:
        return ""
    if r["level"] == "unknown":
        return f" · risk UNKNOWN: {r['reason']}"
    return f" · risk {r['level'].upper()} ({r['prod_direct']} prod direct; {r['prod_total']} prod / {r['test_total']} test total)"


def _direct_text(d: dict) -> str:
    out = "no direct callers"
    if d["callers"]:
        out = f"{_n(d['sites'], 'call site')} in {_n(d['callers'], 'caller')} across {_n(d['files'], 'file')}"
    return out + (f" (imported in {_n(d['imported_by_files'], 'file')})" if d["imported_by_files"] else "")


def _site_text(c: dict, indent: str) -> str:
    lines = [str(x) for x in c["lines"][:LINES_PER_CALLER]]
    if len(c["lines"]) > LINES_PER_CALLER:
        lines.append(f"+{len(c['lines']) - LINES_PER_CALLER}")
    marks = ("" if c["edge"] == "calls" else f" [{c['edge']}]") + (" [test]" if c["caller"]["role"] == "test" else "")
    marks += {"extracted": "", "inferred": " (inferred)"}.get(c["confidence"], " (name guess)")
    by = ""
    if c["called_by"]:
        more = c["called_by_total"] - len(c["called_by"])
        by = f"  ← called by {', '.join(c['called_by'])}" + (f" (+{more})" if more > 0 else "")
    return f"{indent}{c['caller']['path']}:{','.join(lines)}  in {c['caller']['local']}{marks}{by}"


def _site_lines(sites: list[dict], total: int, cap: int | None, indent: str) -> list[str]:
    shown = sites if cap is None else sites[:cap]
    more = total - len(shown)
    return [_site_text(c, indent) for c in shown] + ([f"{indent}… {more} more {'caller' if more == 1 else 'callers'} — `--all` lists every call site"] if more > 0 else [])


def _indirect_lines(ind: dict, depth: int) -> list[str]:
    if not ind or not ind["total"]:
        return []
    span = "depth 2" if depth <= 2 else f"depth 2–{depth}"
    out = [f"indirect ({span}): {_n(ind['total'], 'symbol')} ({ind['prod']} prod, {ind['test']} test) in {_n(ind['modules'], 'dir')}"]
    out += [f"  {g['module']}/  {g['count']}  e.g. {', '.join(g['top'])}" for g in ind["groups"][:TOP_GROUPS]]
    rest = ind["modules"] - min(TOP_GROUPS, len(ind["groups"]))
    return out + ([f"  … {_n(rest, 'dir')} more"] if rest > 0 else [])


def _override_lines(rows: list[dict], indent: str) -> list[str]:
    label = {"overridden_by": "overridden in subclass"}
    return [f"{indent}{label.get(o['relation'], 'overrides base')}: {o['symbol']['local']}  {o['symbol']['path']}:{o['symbol']['start_line']}  — keep signatures compatible" for o in rows]


def _blast_lines(env: dict, show_all: bool) -> list[str]:
    r = env["result"]
    if r["target"]["status"] != "found":
        return _lookup_lines(r["target"])
    sym = r["target"]["symbol"]
    out = [_head(sym), f"{_completeness_text(env, sym['qualified'].split('.')[-1])} · {_direct_text(r['direct'])}{_risk_text(r['risk'])}"]
    if r["direct"]["callers"]:
        out += ["direct:", *_site_lines(r["call_sites"], r["direct"]["callers"], None if show_all else TOP_CALLERS, "  ")]
    out += _indirect_lines(r["indirect"], r["dependents"]["summary"]["depth_limit"])
    t = r["tests"]
    if not t["total"]:
        out.append(f"tests: none reach {sym['local']} within depth {t['depth_limit']} ⚠")
    else:
        out.append(f"tests reaching {sym['local']}: {t['total']} (nearest first)")
        out += [f"  {x['node_id']}  (depth {x['depth']})" for x in t["items"][:TOP_TESTS]]
        more = t["total"] - min(TOP_TESTS, len(t["items"]))
        out += [f"  … {more} more"] if more > 0 else []
    return out + _override_lines(r["overrides"], "")


def _diff_lines(env: dict, show_all: bool) -> list[str]:
    r = env["result"]
    changed, unmapped = r["changed"], r["unmapped"]
    files = {c["symbol"]["path"] for c in changed}
    lost = f" · {_n(len(unmapped), 'hunk')} not in any indexed symbol" if unmapped else ""
    out = [f"diff: {_n(len(changed), 'changed symbol')} in {_n(len(files), 'file')}{lost}", _completeness_text(env) + _risk_text(r["risk"])]
    for c in changed:
        s = c["symbol"]
        ranges = ",".join(str(a) if a == b else f"{a}-{b}" for a, b in c["hunks"])
        gaps = f" · {c['reference_gaps']} unresolved refs with this name" if c["reference_gaps"] else ""
        out.append(f"changed {s['path']}:{ranges}  {s['local']}  [{s['kind']}] · {_direct_text(c['direct'])} · risk {c['risk'].upper()}{gaps}")
        out += _site_lines(c["call_sites"], c["direct"]["callers"], None if show_all else TOP_CHANGED_CALLERS, "    ") + _override_lines(c["overrides"], "    ")
    out += _indirect_lines(r["indirect"], r["dependents"]["summary"]["depth_limit"])
    t = r["tests"]
    if t["total"]:
        out += [f"tests to run: {t['total']} (nearest first)", *(f"  {x['node_id']}" for x in t["items"][:TOP_TESTS])]
        more = t["total"] - min(TOP_TESTS, len(t["items"]))
        out += [f"  … {more} more"] if more > 0 else []
    elif changed:
        out.append(f"tests: none reach the changed symbols within depth {t['depth_limit']} ⚠")
    out += [f"unmapped {h['path']}:{h['start_line']}+{h['line_count']}  ({h['reason']})" for h in unmapped[:TOP_UNMAPPED]]
    rest = len(unmapped) - TOP_UNMAPPED
    return out + ([f"… {_n(rest, 'hunk')} more unmapped"] if rest > 0 else [])


def render_text(env: dict, show_all: bool = False) -> str:
    """An envelope as lines: verdict first, so that a cut keeps what matters."""
    out = [f"STALE: index is behind the working tree; answer reflects rev {env['graph_rev']}"] if env["stale"] else []
    body = {"lookup": lambda: _lookup_lines(env["result"]), "blast_radius": lambda: _blast_lines(env, show_all), "diff_impact": lambda: _diff_lines(env, show_all)}
    out += body[env["query"]]()
    for d in env["disclosures"]:
        what, coarse = d["what"], d["reason"].startswith("tier ")
        if what == "depth":
            out.append(f"note: {d['reason']} (--depth N)")
        elif what in ("candidates", "covering_tests") or (not coarse and (what == "dependents" or show_all and what in ("call_sites", "changed_call_sites"))):
            out.append(f"note: {d['reason']}")
    if env["query"] != "lookup":
        out.append("more: --depth N · --all · --json")
    return "\n".join(out) + "\n"


def render_json(env: dict) -> str:
    return json.dumps(env, ensure_ascii=False)


# --- judged searches within a byte budget ---


def overhead(size: int) -> int:
    """Bytes an answer may take beyond the plain output."""
    return max(384, min(1024, size // 4))


def pack_lines(full: list[str], paths: list[str], budget: int) -> tuple[list[str], int]:
    """As many whole lines as fit, in order; the rest collapsed to one line a file, as far as those fit.

    ``full``: rendered lines by rank; ``paths``: the file of each.  Returns lines and how many matches are
    neither shown nor collapsed."""
    size = [len(x.encode()) + 1 for x in full]
    lo, hi = 0, len(full)
    while lo < hi:  # the most full lines that leave room to collapse the others
        mid = (lo + hi + 1) // 2
        if sum(size[:mid]) + sum(len(x.encode()) + 1 for x in _collapsed(paths[mid:])) <= budget:
            lo = mid
        else:
            hi = mid - 1
    out, room = full[:lo], budget - sum(size[:lo])
    lost = 0
    for line, n in zip(_collapsed(paths[lo:]), _counts(paths[lo:]).values()):
        if len(line.encode()) + 1 <= room:
            out.append(line)
            room -= len(line.encode()) + 1
        else:
            lost += n
    return out, lost


def _counts(paths: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for p in paths:
        out[p] = out.get(p, 0) + 1
    return out


def _collapsed(paths: list[str]) -> list[str]:
    return [f"{p}: {_n(n, 'more match', 'more matches')}" for p, n in _counts(paths).items()]


def greedy_fill(blocks: list[tuple[str, int]], budget: int) -> list[str]:
    """Blocks in order that fit what is left; one that doesn't is skipped, later ones may still fit."""
    out, left = [], budget
    for text, size in blocks:
        if size <= left:
            out.append(text)
            left -= size
    return out
