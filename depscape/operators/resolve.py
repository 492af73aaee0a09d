"""Cross-file resolution: every raw edge to one outcome, by the first tier that has candidates.

Tiers, strongest first: *direct* (bound by the extractor), *import* (the import path ends a symbol's
qualified name), *inherit* (a member of a base class, nearest first), *qual* (receiver and name end a
qualified name) and *name* (the only symbol of that name).

Suffix conditions become equality joins: each symbol is listed once for every suffix of its qualified
name at a separator.  All tiers are one union, decided by a single aggregation per edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import import_head
from ..model import DYNAMIC, EXTERNAL, MODULE, SELF_RECEIVERS, SEPARATORS, SYMBOL_KINDS, WILDCARD
from .iterate import Steps, is_empty

# Names of methods of built-in and standard types.  A call of one on an unknown receiver is
# more often the built-in's than that of the only repository method of that name.
BUILTIN_METHODS = """
get items keys values update pop popitem setdefault copy clear append extend insert remove sort reverse index count
split rsplit join strip lstrip rstrip replace format startswith endswith lower upper title capitalize encode decode
find rfind splitlines partition rpartition zfill isdigit isalpha add discard union intersection difference issubset
read write close readline readlines seek tell flush search match fullmatch sub findall finditer group groups post put
patch delete head json exists mkdir glob rglob iterdir is_file is_dir open resolve unlink rename read_text write_text
read_bytes write_bytes cancel result done wait set is_set acquire release put_nowait get_nowait total_seconds isoformat
strftime timestamp astimezone hexdigest digest
""".split()
_CALLABLE = ("function", "method", "class", "struct")
_BASE = ("class", "struct", "trait", "interface")
_MAX_INHERITANCE = 32
_SPECIAL = (MODULE, WILDCARD, DYNAMIC)


def compatible(edge_kind: Column, symbol_kind: Column) -> Column:
    """Whether a reference of a kind may bind to a symbol of a kind."""
    return (
        F.when(edge_kind.isin("calls", "tests"), symbol_kind.isin(*_CALLABLE))
        .when(edge_kind == "inherits", symbol_kind.isin(*_BASE))
        .otherwise(symbol_kind.isin(*SYMBOL_KINDS))
    )


def _separator(lang: Column) -> Column:
    out = F.lit(".")
    for name, sep in SEPARATORS.items():
        out = F.when(lang == name, F.lit(sep)).otherwise(out)
    return out


def qualified_suffixes(symbols: DataFrame) -> DataFrame:
    """lang, suffix, whole, and the symbol's id, name, kind, path: a row for each suffix of its qualified name."""
    sep = _separator(F.col("lang"))
    parts = F.split(F.col("qualified"), F.when(F.col("lang") == "rust", F.lit("::")).otherwise(F.lit(r"\.")))
    s = symbols.select("id", "name", "lang", "kind", "path", sep.alias("sep"), parts.alias("parts"))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("parts"))))
    suffix = F.array_join(F.slice("parts", F.col("i"), F.size("parts") - F.col("i") + 1), "\u0000")
    return s.select(
        F.col("lang"), F.replace(suffix, F.lit("\u0000"), F.col("sep")).alias("suffix"), (F.col("i") == 1).alias("whole"),
        F.col("id").alias("d"), F.col("name").alias("dname"), F.col("kind").alias("dkind"), F.col("path").alias("dpath"),
    )


_KEY = ("path", "idx")
_IMPORT = ("key_name", "lang", "ekind", "import_path", "module")
# What decides an edge, apart from its path; x: the source, where the receiver is the object itself.
_SHAPE = ("lang", "kind", "dst_id", "name", "key_name", "qualifier", "import_path", "x")


def import_keys(open_: DataFrame) -> DataFrame:
    """Edges with an import path in the repository, and what their candidates depend on."""
    e = open_.filter(F.col("import_path").isNotNull() & ~F.startswith("import_path", F.lit(EXTERNAL)))
    free = F.coalesce(~F.col("name").isin(MODULE, WILDCARD), F.lit(False))
    return e.withColumns({"ekind": F.col("kind"), "module": ~free})


def import_hits(keys: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Symbols whose qualified name is a key's import path or ends with it at a separator."""
    on = (keys["lang"] == suffixes["lang"]) & (keys["import_path"] == suffixes["suffix"]) & (keys["key_name"] == suffixes["dname"])
    hit = keys.join(suffixes, on).filter(compatible(F.col("ekind"), F.col("dkind")) & (~F.col("module") | (F.col("dkind") == "module")))
    return hit.select("key_name", keys["lang"], "ekind", "import_path", "module", "d", "dpath")


def _prefixes(path: str) -> Column:
    """(length, text) of each run of a path's leading segments, the empty one first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))


def nearest_imports(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """kid, path, near: the only candidate among those that share most leading segments with an edge's path.

    ``edges``: kid, path; ``hits``: kid, d, dpath."""
    groups = hits.filter("dpath is not null").select("kid", "d", F.explode(_prefixes("dpath")).alias("p")).groupBy("kid", "p.k", "p.at")
    groups = groups.agg(F.count_distinct("d").alias("n"), F.min("d").alias("one"))
    at = edges.filter("path is not null").distinct().select("kid", "path", F.explode(_prefixes("path")).alias("p")).select("kid", "path", "p.k", "p.at")
    best = at.join(groups, ["kid", "k", "at"]).groupBy("kid", "path").agg(F.max(F.struct("k", "n", "one")).alias("b"))
    return best.filter("b.n = 1").select("kid", "path", F.col("b.one").alias("near"))


def base_classes(raw_edges: DataFrame, suffixes: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, idx, k, b: inherits edges of class k that reach a base b in the repository."""
    inherits = raw_edges.filter("kind = 'inherits'")
    bound = inherits.filter("dst_id is not null").select(*_KEY, F.col("src").alias("k"), F.col("dst_id").alias("b"))
    bound = bound.join(symbols.select(F.col("id").alias("b")), "b", "left_semi").select(*_KEY, "k", "b")
    named = inherits.filter(F.col("dst_id").isNull() & F.col("import_path").isNotNull() & ~F.startswith("import_path", F.lit(EXTERNAL)))
    cls = suffixes.filter("dkind = 'class'")
    hit = named.join(cls, (named["lang"] == cls["lang"]) & (named["import_path"] == cls["suffix"]) & (named["key_name"] == cls["dname"]))
    return bound.unionByName(hit.select(*_KEY, F.col("src").alias("k"), F.col("d").alias("b")))


def enclosing_classes(symbols: DataFrame, sources: DataFrame, steps: Steps) -> DataFrame:
    """x, k: the nearest class among the ancestors of each source."""
    up = symbols.select("id", "parent").filter("parent is not null")
    kinds = symbols.select(F.col("id").alias("p"), F.col("kind").alias("pkind"))
    at = sources.select(F.col("src").alias("x")).distinct().join(up.withColumnRenamed("id", "x"), "x").withColumnRenamed("parent", "p")
    found = seen = None
    while True:
        at = steps.keep(at.join(kinds, "p").select("x", "p", "pkind"))
        if seen is not None:  # a chain of parents that runs in a circle ends where it began
            at = steps.keep(at.join(seen, ["x", "p"], "left_anti"))
        seen = at.select("x", "p") if seen is None else seen.unionByName(at.select("x", "p"))
        here = at.filter("pkind = 'class'").select("x", F.col("p").alias("k"))
        found = here if found is None else found.unionByName(here)
        rest = at.filter("pkind <> 'class'")
        if is_empty(rest):
            return found
        at = rest.select("x", "p").join(up.withColumnRenamed("id", "p"), "p").select("x", F.col("parent").alias("p"))


def ancestors(roots: DataFrame, bases: DataFrame, steps: Steps, most: int = _MAX_INHERITANCE) -> DataFrame:
    """k, a, depth: base classes of each root class at their least depth; a cycle may contain the root itself."""
    base = bases.select(F.col("k").alias("m"), F.col("b").alias("a")).distinct()
    front = roots.select("k").distinct().join(base.withColumnRenamed("m", "k"), "k").select("k", "a", F.lit(1).alias("depth"))
    known = steps.keep(front)
    front = known
    for depth in range(2, most + 1):
        step = front.select("k", F.col("a").alias("m")).join(base, "m").select("k", "a").distinct()
        front = steps.keep(step.join(known, ["k", "a"], "left_anti").withColumn("depth", F.lit(depth)))
        if is_empty(front):
            break
        known = steps.keep(known.unionByName(front))
    return known


def resolve(symbols: DataFrame, raw_edges: DataFrame, todo: DataFrame | None = None) -> DataFrame:
    """One outcome for each edge (of ``todo`` (path, idx), or all): columns of ``model.RESOLUTION``."""
    steps = Steps(symbols.sparkSession, "resolve")
    edges = raw_edges if todo is None else raw_edges.join(todo.select(*_KEY).distinct(), list(_KEY), "left_semi")
    selfish = F.col("import_path").isNull() & F.col("qualifier").isin(*SELF_RECEIVERS)
    unself = F.col("qualifier").isNotNull() & ~F.col("qualifier").isin(*SELF_RECEIVERS)
    edges = steps.keep(edges.withColumn("x", F.when(F.col("dst_id").isNull() & selfish, F.col("src"))))
    shapes = steps.keep(edges.select(*_SHAPE).distinct().withColumn("sid", F.monotonically_increasing_id()))
    open_ = shapes.filter("dst_id is null")
    symbols = steps.keep(symbols.select("id", "name", "lang", "kind", "path", "parent", "qualified"))
    names = open_.select("name").unionByName(open_.select(F.col("key_name").alias("name")))
    names = names.unionByName(raw_edges.filter("kind = 'inherits'").select(F.col("key_name").alias("name"))).distinct()
    known = steps.keep(symbols.join(names, "name", "left_semi"))
    suffixes = steps.keep(qualified_suffixes(known))
    few = [F.count_distinct("d").alias("n"), F.min("d").alias("one")]

    direct = shapes.filter("dst_id is not null").join(symbols.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("sid", F.lit(True).alias("direct"))

    # kid: imports of several candidates at different paths, of which the edge's own path may pick one.
    wanted = import_keys(open_)
    hits = steps.keep(import_hits(wanted.select(*_IMPORT).distinct(), suffixes))
    apart = F.coalesce((F.min("dpath") != F.max("dpath")) | (F.count("dpath") < F.count("*")), F.lit(True)).alias("apart")
    keys = hits.groupBy(*_IMPORT).agg(*few, apart).withColumn("kid", F.monotonically_increasing_id())
    keys = steps.keep(keys.withColumn("kid", F.when((F.col("n") > 1) & F.col("apart"), F.col("kid"))).drop("apart"))
    imports = wanted.join(keys, list(_IMPORT)).select("sid", F.col("n").alias("import_n"), F.col("one").alias("import_one"), "kid")

    # Members of base classes, and the edges whose class has a base outside the repository.
    selfs = open_.filter("x is not null")
    of_class = steps.keep(enclosing_classes(symbols, selfs.select(F.col("x").alias("src")), steps))
    bases = steps.keep(base_classes(raw_edges, suffixes, symbols))
    anc = ancestors(of_class, bases, steps)
    external = raw_edges.filter("kind = 'inherits' and dst_id is null").join(bases, list(_KEY), "left_anti").select(F.col("src").alias("a")).distinct()
    reach = of_class.select("k").distinct().withColumn("a", F.col("k")).unionByName(anc.select("k", "a"))
    ext_class = reach.join(external, "a", "left_semi").select("k").distinct()
    selfs = selfs.join(of_class, "x")
    ext_self = steps.keep(selfs.join(ext_class, "k", "left_semi").select("sid"))
    members = known.filter("parent is not null").select(F.col("parent").alias("a"), F.col("id").alias("d"), F.col("name").alias("dname"), F.col("kind").alias("dkind"))
    inherit = selfs.select("sid", "k", F.col("kind").alias("ekind"), F.col("name").alias("dname")).join(anc, "k").join(members, ["a", "dname"])
    inherit = inherit.filter(compatible(F.col("ekind"), F.col("dkind"))).groupBy("sid", "depth").agg(*few)
    inherit = inherit.groupBy("sid").agg(F.min(F.struct("depth", "n", "one")).alias("b")).select("sid", F.col("b.n").alias("inherit_n"), F.col("b.one").alias("inherit_one"))

    # Receiver and name, as a proper suffix.
    q = open_.filter(F.col("import_path").isNull() & unself & ~F.col("name").isin(*_SPECIAL))
    q = q.select("sid", "lang", F.col("kind").alias("ekind"), F.col("name").alias("dname"), F.concat("qualifier", _separator(F.col("lang")), "name").alias("suffix"))
    of_qual = ["lang", "suffix", "dname", "ekind"]
    qual = q.select(*of_qual).distinct().join(suffixes.filter("not whole"), ["lang", "suffix", "dname"]).filter(compatible(F.col("ekind"), F.col("dkind")))
    qual = q.join(qual.groupBy(*of_qual).agg(*few), of_qual).select("sid", F.col("n").alias("qual_n"), F.col("one").alias("qual_one"))

    # The name alone.
    heads = symbols.filter("kind = 'module'").select("lang", F.col("name").alias("head")).distinct()
    named = open_.filter(~F.col("name").isin(*_SPECIAL)).join(ext_self, "sid", "left_anti").withColumn("head", import_head("import_path"))
    free = named.filter("import_path is null")
    in_repo = named.filter("head is not null").join(heads, ["lang", "head"], "left_semi")
    named = free.unionByName(in_repo.select(*free.columns))
    risky = F.col("import_path").isNull() & unself & F.col("name").isin(*BUILTIN_METHODS) & (F.col("lang") == "python")
    named = named.select("sid", "lang", F.col("kind").alias("ekind"), "name", risky.alias("risky"))
    of_name = ["name", "lang", "ekind"]
    counted = (
        named.select(*of_name).distinct().join(known.select("name", "lang", F.col("id").alias("d"), F.col("kind").alias("dkind")), ["name", "lang"])
        .filter(compatible(F.col("ekind"), F.col("dkind"))).groupBy(*of_name).agg(*few)
    )
    name = named.join(counted, of_name).select(
        "sid", F.when(F.col("risky"), F.col("n") + 1).otherwise(F.col("n")).alias("name_n"), F.when(~F.col("risky") & (F.col("n") == 1), F.col("one")).alias("name_one")
    )

    every = shapes
    for tier in (direct, imports, inherit, qual, name):
        every = every.join(tier, "sid", "left")
    every = steps.keep(every.select(*[F.col(c).alias(f"_{c}") for c in _SHAPE], "direct", "kid", _outcome().alias("o")))
    same = F.lit(True)
    for c in _SHAPE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = edges.join(every, same)
    o = F.when(F.col("direct"), _one(F.col("dst_id"), F.col("prov"))).otherwise(F.col("o"))
    apart = keys.filter("kid is not null")
    if not is_empty(apart):
        at = import_keys(edges.filter("dst_id is null")).join(apart.select(*_IMPORT, "kid"), list(_IMPORT)).select("kid", "path")
        near = nearest_imports(at, hits.join(apart.select(*_IMPORT, "kid"), list(_IMPORT)).select("kid", "d", "dpath"))
        out = out.join(near, ["kid", "path"], "left")
        o = F.when(F.col("near").isNotNull(), _one(F.col("near"), F.lit("resolved"))).otherwise(o)
    return out.withColumn("o", o).select(*_KEY, "src", "kind", "site_line", "o.outcome", "o.dst", "o.provenance", "o.candidates")


def _result(outcome: str, dst: Column | None = None, provenance: Column | None = None, candidates: Column | None = None) -> Column:
    typed = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(
        F.lit(outcome).alias("outcome"), typed(dst, "string").alias("dst"), typed(provenance, "string").alias("provenance"), typed(candidates, "int").alias("candidates")
    )


def _one(dst: Column, provenance: Column) -> Column:
    return _result("resolved", dst, provenance)


def _outcome() -> Column:
    """Of an edge that isn't bound, from the number of candidates in each tier and one of them."""
    def pick(tier: str, provenance: str) -> Column:
        n = F.col(f"{tier}_n")
        return F.when(n == 1, _one(F.col(f"{tier}_one"), F.lit(provenance))).otherwise(_result("ambiguous", candidates=n))

    return (
        F.when(F.col("import_n").isNotNull(), pick("import", "resolved"))
        .when(F.col("inherit_n").isNotNull(), pick("inherit", "inferred"))
        .when(F.col("qual_n").isNotNull(), pick("qual", "inferred"))
        .when(F.col("name_one").isNotNull(), _one(F.col("name_one"), F.lit("name_guess")))
        .when(F.col("name_n") > 1, _result("ambiguous", candidates=F.col("name_n")))
        .otherwise(_result("unresolved"))
    )


def links(resolution: DataFrame) -> DataFrame:
    """Resolved edges, columns of ``model.LINK``."""
    return resolution.filter("outcome = 'resolved'").select(*_KEY, "src", "dst", "kind", F.col("provenance").alias("prov"), "site_line")
