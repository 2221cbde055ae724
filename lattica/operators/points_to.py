"""Points-to sets with an on-the-fly call graph: one semi-naive loop over mutually recursive relations.

Relations: reachable(m, ctx), pts(v, ctx, heap, hctx), fpts(heap, hctx, f, heap2, hctx2), flow(src, sctx, dst, dctx),
call_edge(m, ctx, site, callee, ectx). Values are numbered program-wide; static fields, returns, exception exits and
formals are values like any other. ``CONTENTS`` is the field of all elements of an array.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.contexts import Abstraction
from lattica.operators.fixpoint import Relations, follow, grow, minus, settle, union_all

CONTENTS = -1
#: Statement tables and their columns; every statement lies in method m.
STATEMENTS = {
    "new": "m long, v long, site long", "assign": "m long, dst long, src long, filter long", "load": "m long, dst long, base long, f long", "store": "m long, base long, f long, src long",
    "sload": "m long, dst long, f long", "sstore": "m long, f long, src long", "class_init": "m long, clinit long",
    "call": "m long, site long, dispatch string, target long, selector string, receiver long, result long, exc long",
    "actual": "site long, i int, v long", "formal": "m long, i int, v long", "returns": "m long, v long", "throws": "m long, v long",
    "alloc": "site long, type long, type_name string, alloc_class long, alloc_class_name string", "dispatch": "t long, selector string, m long",
    "filter_ok": "filter long, t long", "static_var": "f long, v long", "is_init": "m long", "elem_ok": "type long, t long", "clone": "site long, fresh long",
    "method_name": "m long, name string", "klass_name": "t long, name string", "subtype": "sup long, sub long",
}


@dataclass
class Program:
    """Statement tables; those not given are empty. ``elem_ok`` says which types an array of a type may hold."""

    tables: dict[str, DataFrame]
    entry: DataFrame
    haf: Abstraction = field(default_factory=Abstraction)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.entry.sparkSession.createDataFrame([], STATEMENTS[name])
        return self.tables[name]


def _site_facts(p: Program) -> DataFrame:
    a = p["alloc"]
    return a.select(F.col("site").alias("heap"), F.col("type").alias("heap_class"), F.col("type_name").alias("heap_class_name"), "alloc_class", "alloc_class_name")


def _supers(p: Program) -> DataFrame | None:
    """(heap_class, heap_supers): the names of each class and all above it, if the abstraction asks for them."""
    if not p.haf.needs("heap_supers"):
        return None
    if "klass_name" not in p.tables or "subtype" not in p.tables:
        raise ValueError(f"{p.haf} needs the tables klass_name and subtype")
    named = p["subtype"].join(p["klass_name"].select(F.col("t").alias("sup"), "name"), "sup")
    return named.groupBy(F.col("sub").alias("heap_class")).agg(F.collect_set("name").alias("heap_supers"))


def _passes(df: DataFrame, p: Program) -> DataFrame:
    """Rows (…, filter, heap, …) whose object's type passes the filter; rows without a filter pass."""
    typed = df.where("filter is not null").join(p["alloc"].select(F.col("site").alias("heap"), F.col("type").alias("t")), "heap").join(p["filter_ok"], ["filter", "t"], "left_semi").drop("t")
    return df.where("filter is null").unionByName(typed.select(*df.columns))


def _of_row(ctx: Column) -> Column:
    """``ctx`` as a value of each row, also where it is one constant: plans that fold it fail on checkpointed inputs."""
    return F.concat(ctx, F.slice(F.col("ctx"), 1, 0))


def _row(df: DataFrame, **more) -> dict:
    return {**{c: df[c] for c in df.columns}, **more}


def _step(p: Program):
    """One evaluation of all rules: what follows from new rows ``d`` and all rows ``t``."""
    haf, given = p.haf, set(p.tables)  # of tables that are not given no rule is planned
    statics = p["static_var"].select("f", F.col("v").alias("fv"))
    sites = _site_facts(p)
    store = p["store"].select("base", "f", F.col("src").alias("s"))
    load = p["load"].select("base", "f", F.col("dst").alias("d"))
    calls = p["call"]
    has_receivers = not calls.where("dispatch <> 'static'").isEmpty()
    init = p["is_init"].select(F.col("m").alias("callee"), F.lit(True).alias("init")) if "is_init" in given else None

    supers = _supers(p)
    if p.haf.needs("callee_name") and "method_name" not in p.tables:
        raise ValueError(f"{p.haf} needs the table method_name")

    def merged(found: DataFrame, static: bool) -> DataFrame:
        """found: (m, ctx, site, callee, heap, hctx, heap facts) with the callee's context."""
        f = found.withColumn("is_init", F.lit(False)) if init is None else found.join(init, "callee", "left").withColumn("is_init", F.coalesce("init", F.lit(False)))
        if "method_name" in given:
            f = f.join(p["method_name"].select(F.col("m").alias("callee"), F.col("name").alias("callee_name")), "callee", "left")
        else:
            f = f.withColumn("callee_name", F.lit(None).cast("string"))
        f = f.join(supers, "heap_class", "left") if supers is not None and not static else f.withColumn("heap_supers", F.array("heap_class_name"))
        return f.withColumn("ectx", _of_row(haf.merge(_row(f, is_static=F.lit(static)))))

    def static_calls(reach: DataFrame) -> DataFrame:
        c = calls.where("dispatch = 'static'").join(reach, "m").withColumnRenamed("target", "callee")
        null = F.lit(None).cast("long")
        c = c.withColumn("heap", null).withColumn("hctx", haf.initial()).withColumn("heap_class", null).withColumn("alloc_class", null).withColumn("heap_class_name", F.lit(None).cast("string"))
        return merged(c, True).select("m", "ctx", "site", "callee", "ectx")

    def receiver_calls(pts: DataFrame) -> DataFrame:
        """Calls with a receiver object, one row an object: fixed targets, or the dispatch of its class, else the target."""
        c = calls.where("dispatch <> 'static'").join(pts.withColumnRenamed("v", "receiver"), "receiver").join(sites, "heap", "left")
        d = p["dispatch"].select(F.col("t").alias("heap_class"), "selector", F.col("m").alias("found"))
        c = c.join(d, ["heap_class", "selector"], "left")
        c = c.withColumn("callee", F.when(F.col("dispatch") == "special", F.col("target")).otherwise(F.coalesce("found", "target"))).where("callee is not null")
        return merged(c, False)

    def flows(edges: DataFrame) -> list[DataFrame]:
        """Value flows of new call edges: arguments after the receiver, results and exceptions."""
        act, form = p["actual"], p["formal"].select(F.col("m").alias("callee"), "i", F.col("v").alias("dst"))
        kind = calls.select("site", "dispatch", "result", "exc")
        e = edges.join(kind, "site")
        args = e.join(act.withColumnRenamed("v", "src"), "site").where("dispatch = 'static' or i > 0").join(form, ["callee", "i"])
        back = lambda table, to: e.where(f"{to} is not null").join(p[table].select(F.col("m").alias("callee"), F.col("v").alias("src")), "callee").select("src", F.col("ectx").alias("sctx"), F.col(to).alias("dst"), F.col("ctx").alias("dctx"))
        return [args.select("src", F.col("ctx").alias("sctx"), "dst", F.col("ectx").alias("dctx")), *[back(table, to) for table, to in (("returns", "result"), ("throws", "exc")) if table in given]]

    def along(pts: DataFrame, flow: DataFrame) -> DataFrame:
        hit = pts.join(flow, (pts["v"] == flow["src"]) & (pts["ctx"] == flow["sctx"]))
        return hit.select(F.col("dst").alias("v"), F.col("dctx").alias("ctx"), "heap", "hctx")

    def loads(pts: DataFrame, fpts: DataFrame) -> DataFrame:
        b = pts.withColumnRenamed("v", "base").join(load, "base")
        return b.join(fpts, ["heap", "hctx", "f"]).select(F.col("d").alias("v"), "ctx", F.col("heap2").alias("heap"), F.col("hctx2").alias("hctx"))

    def stores(on_base: DataFrame, on_src: DataFrame) -> DataFrame:
        b = on_base.withColumnRenamed("v", "base").join(store, "base")
        s = on_src.select(F.col("v").alias("s"), "ctx", F.col("heap").alias("heap2"), F.col("hctx").alias("hctx2"))
        hit = b.join(s, ["s", "ctx"]).select("heap", "hctx", "f", "heap2", "hctx2")
        if "elem_ok" not in given:
            return hit
        types = lambda c: p["alloc"].select(F.col("site").alias(c), F.col("type").alias("t" if c == "heap2" else "type"))
        ok = hit.where(f"f = {CONTENTS}").join(types("heap"), "heap").join(types("heap2"), "heap2").join(p["elem_ok"], ["type", "t"], "left_semi")
        return hit.where(f"f <> {CONTENTS}").unionByName(ok.select(*hit.columns))

    def linked(out: dict[str, list[DataFrame]], edges: DataFrame) -> None:
        """Call edges with all that follows from them at once: the callee is reached, and values flow."""
        out["call_edge"].append(edges)
        out["reachable"].append(edges.select(F.col("callee").alias("m"), F.col("ectx").alias("ctx")))
        out["flow"] += flows(edges.distinct())

    def step(d: Relations, t: Relations) -> dict[str, list[DataFrame]]:
        out: dict[str, list[DataFrame]] = {k: [] for k in t}
        heap_used = not given.isdisjoint(("load", "store", "clone"))
        c0 = _of_row(haf.initial())
        if "reachable" in d:
            reach = d["reachable"]
            fresh = p["new"].join(reach, "m").join(sites.withColumnRenamed("heap", "site"), "site", "left")
            out["pts"].append(fresh.select("v", "ctx", F.col("site").alias("heap"), _of_row(haf.record(_row(fresh))).alias("hctx")))
            linked(out, static_calls(reach))
            if "static_var" in given:
                out["flow"].append(p["sload"].join(reach, "m").join(statics, "f").select(F.col("fv").alias("src"), c0.alias("sctx"), "dst", F.col("ctx").alias("dctx")))
                out["flow"].append(p["sstore"].join(reach, "m").join(statics, "f").select("src", F.col("ctx").alias("sctx"), F.col("fv").alias("dst"), c0.alias("dctx")))
            if "class_init" in given:
                out["reachable"].append(p["class_init"].join(reach, "m").select(F.col("clinit").alias("m"), c0.alias("ctx")))
        if "pts" in d:
            pts = d["pts"]
            copied = _passes(pts.join(p["assign"].withColumnRenamed("dst", "to").withColumnRenamed("src", "v").drop("m"), "v"), p)
            out["pts"] += [copied.select(F.col("to").alias("v"), "ctx", "heap", "hctx"), along(pts, t["flow"])]
            if has_receivers:
                hit = receiver_calls(pts)
                this = hit.join(p["formal"].where("i = 0").select(F.col("m").alias("callee"), F.col("v").alias("this")), "callee")
                out["pts"].append(this.select(F.col("this").alias("v"), F.col("ectx").alias("ctx"), "heap", "hctx"))
                linked(out, hit.select("m", "ctx", "site", "callee", "ectx"))
            if heap_used:
                out["pts"].append(loads(pts, t["fpts"]))
                out["fpts"] += [stores(pts, t["pts"]), stores(t["pts"], pts)]
        if "fpts" in d:
            out["pts"].append(loads(t["pts"], d["fpts"]))
        if "flow" in d:
            out["pts"].append(along(t["pts"], d["flow"]))
        if "clone" in given:
            cloned(out, d, t)
        return out

    def cloned(out: dict[str, list[DataFrame]], d: Relations, t: Relations) -> None:
        """``clone`` calls: a new object (``fresh`` site) per receiver class, with the receiver's fields copied."""
        c = calls.join(p["clone"], "site").select("receiver", "result", "fresh")
        copy = lambda pts, fp: pts.join(c, pts["v"] == c["receiver"]).join(fp, ["heap", "hctx"]).select(F.col("fresh").alias("heap"), F.col("ctx").alias("hctx"), "f", "heap2", "hctx2")
        if "pts" in d:
            out["pts"].append(d["pts"].join(c, d["pts"]["v"] == c["receiver"]).select(F.col("result").alias("v"), "ctx", F.col("fresh").alias("heap"), F.col("ctx").alias("hctx")))
            out["fpts"].append(copy(d["pts"], t["fpts"]))
        if "fpts" in d:
            out["fpts"].append(copy(t["pts"], d["fpts"]))

    return step


def solve(p: Program, most_rounds: int = 1000) -> Relations:
    """The least fixpoint; see the module for its relations."""
    spark = p.entry.sparkSession
    p = Program({k: settle(v) for k, v in p.tables.items()}, settle(p.entry), p.haf)
    seed = {
        "reachable": p.entry.select("m").distinct().select("m", p.haf.initial().alias("ctx")),
        "pts": spark.createDataFrame([], "v long, ctx array<long>, heap long, hctx array<long>"),
        "fpts": spark.createDataFrame([], "heap long, hctx array<long>, f long, heap2 long, hctx2 array<long>"),
        "flow": spark.createDataFrame([], "src long, sctx array<long>, dst long, dctx array<long>"),
        "call_edge": spark.createDataFrame([], "m long, ctx array<long>, site long, callee long, ectx array<long>"),
    }
    heap = not p.tables.keys().isdisjoint(("load", "store"))
    step = _step(p)
    if "clone" in p.tables or not p["call"].where("dispatch <> 'static'").isEmpty():
        return grow(seed, step, most_rounds, sparse=True)
    return _Strata(heap, seed, step, most_rounds)


class _Strata(Mapping):
    """The relations of a program whose calls all are static: who calls whom does not depend on what values point to, so it is
    settled first, flows are found once, and the sets follow. What is not asked for is not worked out."""

    def __init__(self, heap: bool, seed: Relations, step: Callable, most_rounds: int):
        self.heap, self.seed, self.step, self.most_rounds, self.found = heap, seed, step, most_rounds, {}

    def __iter__(self):
        return iter(self.seed)

    def __len__(self):
        return len(self.seed)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.found:
            if name not in self.seed:
                raise KeyError(name)
            self.found |= self._sets() if name in ("pts", "fpts") else {name: self._reachable() if name == "reachable" else self._once(name)}
        return self.found[name]

    def _of(self, reach: DataFrame, name: str) -> DataFrame:
        frames = self.step({"reachable": reach}, self.seed)[name]
        return union_all([f.select(*self.seed[name].columns) for f in frames]) if frames else self.seed[name]

    def _reachable(self) -> DataFrame:
        return follow(self.seed["reachable"], lambda new: self._of(new, "reachable"), self.most_rounds)

    def _once(self, name: str) -> DataFrame:
        return settle(self._of(self["reachable"], name).distinct())

    def _sets(self) -> Relations:
        fixed = {k: self[k] for k in ("reachable", "flow", "call_edge")}
        first, none = self._of(fixed["reachable"], "pts"), self.seed["fpts"]
        if not self.heap:
            spread = lambda new: union_all([f.select(*first.columns) for f in self.step({"pts": new}, self.seed | fixed)["pts"]])
            return {"pts": follow(first, spread, self.most_rounds), "fpts": none}
        rules = lambda d, t: {k: v for k, v in self.step(d, {**t, **fixed}).items() if k in t}
        return grow({"pts": first, "fpts": none}, rules, self.most_rounds, sparse=True)


def copy_closure(new: DataFrame, assign: DataFrame) -> DataFrame:
    """(v, heap): context-insensitive sets of ``new`` (v, heap) carried along ``assign`` (dst, src)."""
    edges = settle(assign.select("src", "dst").distinct())
    return follow(new.select("v", "heap"), lambda d: d.join(edges, d["v"] == edges["src"]).select(F.col("dst").alias("v"), "heap"))


def filtered_closure(new: DataFrame, assign: DataFrame, heap_type: DataFrame, ok: DataFrame) -> DataFrame:
    """As ``copy_closure`` over ``assign`` (dst, src, filter): only objects (``heap_type``: heap, t) that pass move on.

    Several filters on one edge are alternatives; a filter that nothing passes is no edge.
    """
    allowed = settle(heap_type.join(ok, "t").select("filter", "heap").distinct())
    edges = settle(assign.select("src", "dst", "filter").distinct())

    def spread(d):
        hit = d.join(edges, d["v"] == edges["src"])
        free = hit.where("filter is null")
        return union_all([x.select(F.col("dst").alias("v"), "heap") for x in (free, hit.where("filter is not null").join(allowed, ["filter", "heap"], "left_semi"))])

    return follow(new.select("v", "heap"), spread)


def field_closure(new: DataFrame, assign: DataFrame, store: DataFrame, load: DataFrame) -> Relations:
    """Context-insensitive pts (v, heap) and fpts (heap, f, heap2) under copies, field stores and loads."""
    assign, store, load = settle(assign.select("src", "dst").distinct()), settle(store.distinct()), settle(load.distinct())

    def step(d, t):
        copies = d["pts"].join(assign, d["pts"]["v"] == assign["src"]).select(F.col("dst").alias("v"), "heap")
        read = lambda p, f: p.join(load, p["v"] == load["base"]).join(f, ["heap", "f"]).select(F.col("dst").alias("v"), F.col("heap2").alias("heap"))
        write = lambda b, s: b.join(store, b["v"] == store["base"]).select("heap", "f", "src").join(s.select(F.col("v").alias("src"), F.col("heap").alias("heap2")), "src").select("heap", "f", "heap2")
        return {"pts": [copies, read(d["pts"], t["fpts"]), read(t["pts"], d["fpts"])], "fpts": [write(d["pts"], t["pts"]), write(t["pts"], d["pts"])]}

    none = new.select(F.col("heap"), F.lit(0).cast("long").alias("f"), F.col("heap").alias("heap2")).limit(0)
    return grow({"pts": new.select("v", "heap"), "fpts": none}, step)


def paranoid(p: Program, found: Relations) -> dict[str, int]:
    """Rows that one more evaluation of every statement on all of ``found`` would add; all zero at a fixpoint."""
    more = _step(p)(found, found)
    return {k: minus(union_all([f.select(*found[k].columns) for f in frames]), found[k]).count() if frames else 0 for k, frames in more.items()}


def counters(found: Relations) -> DataFrame:
    """One row each, of sets as ``solve`` gives them: graph nodes, points-to edges, field edges, call-graph nodes and edges."""
    n = lambda df: df.groupBy().agg(F.count(F.lit(1)).alias("n"))
    rows = [("nodes", n(found["pts"].select("v", "ctx").distinct())), *[(k, n(found[of])) for k, of in (("edges", "pts"), ("field_edges", "fpts"), ("call_nodes", "reachable"), ("call_edges", "call_edge"))]]
    return union_all([df.select(F.lit(k).alias("counter"), "n") for k, df in rows])


def call_graph_nodes(call_edge: DataFrame, entries: DataFrame, clinits: DataFrame) -> DataFrame:
    """(n): distinct callees, entry points and class initialisers, and one for the root."""
    nodes = call_edge.select(F.col("callee").alias("m")).union(entries.select("m")).union(clinits.select("m"))
    return nodes.agg((F.countDistinct("m") + 1).alias("n"))


def successors(call_edge: DataFrame) -> DataFrame:
    return call_edge.groupBy(F.col("m").alias("caller")).agg(F.sort_array(F.collect_set("callee")).alias("callees"))


def compare_graphs(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (caller, callee) of ``theirs`` that ours lacks although it has the caller, and nodes that ours lacks."""
    nodes = lambda g: g.select(F.col("caller").alias("n")).union(g.select("callee")).distinct()
    edges = theirs.join(ours, ["caller", "callee"], "left_anti").join(nodes(ours).withColumnRenamed("n", "caller"), "caller", "left_semi")
    return edges, nodes(theirs).join(nodes(ours), "n", "left_anti")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, rep): nodes of cycles of ``edges`` (src, dst) with the smallest node of their cycle."""
    from lattica.operators.fixpoint import closure

    reach = closure(edges, edges.select(F.col("dst").alias("node"), F.col("src").alias("item")).distinct())
    back = reach.select(F.col("item").alias("node"), F.col("node").alias("item"))
    return reach.intersect(back).groupBy("node").agg(F.min("item").alias("rep")).select("node", F.least("node", "rep").alias("rep"))


def collapse(assign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copy edges between representatives, and (node, rep): values on one cycle of plain copies have equal sets."""
    reps = strongly_connected(assign.select("src", "dst"))
    r = lambda c: reps.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_rep"))
    out = assign.join(r("src"), "src", "left").join(r("dst"), "dst", "left")
    out = out.select(F.coalesce("src_rep", "src").alias("src"), F.coalesce("dst_rep", "dst").alias("dst")).where("src <> dst").distinct()
    return out, reps
