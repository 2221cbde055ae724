"""Program dependence graphs: nodes and edges as projections of instructions, calls and program counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.operators.fixpoint import union_all

#: Kinds of edges and nodes.
EDGE_TYPES = ("EXP", "COPY", "MERGE", "POINTER", "IMPLICIT", "TRUE", "FALSE", "CONJUNCTION", "SWITCH", "MISSING", "INPUT", "OUTPUT")
NODE_TYPES = (
    "LOCAL", "BASE_VALUE", "OTHER_EXPRESSION", "LOCATION_SUMMARY", "PC_MERGE", "PC_OTHER", "BOOLEAN_TRUE_PC", "BOOLEAN_FALSE_PC", "ENTRY_PC_SUMMARY", "EXIT_PC_JOIN", "NORMAL_EXIT", "EXCEPTION_EXIT",
    "FORMAL_SUMMARY", "FORMAL_ASSIGNMENT", "RETURN_SUMMARY", "EXCEPTION_SUMMARY", "EXIT_ASSIGNMENT", "EXIT_PC_SUMMARY", "THIS",
)
#: Opcode, position of the operand, kind of the edge from operand to result.
DATA_EDGES = (
    ("BINARY_OP", 0, "EXP"), ("BINARY_OP", 1, "EXP"), ("BINARY_OP_EX", 0, "EXP"), ("BINARY_OP_EX", 1, "EXP"), ("COMPARISON", 0, "EXP"), ("COMPARISON", 1, "EXP"), ("CONVERSION", 0, "EXP"),
    ("UNARY_NEG_OP", 0, "EXP"), ("INSTANCE_OF", 0, "EXP"), ("ARRAY_LENGTH", 0, "POINTER"), ("ARRAY_LOAD", 0, "EXP"), ("ARRAY_LOAD", 1, "EXP"), ("ARRAY_STORE", 1, "COPY"), ("ARRAY_STORE", 0, "EXP"),
    ("CHECK_CAST", 0, "COPY"), ("GET_FIELD", 0, "POINTER"), ("PUT_FIELD", 0, "POINTER"), ("PUT_FIELD", 1, "COPY"), ("PUT_STATIC", 0, "COPY"), ("RETURN", 0, "COPY"), ("THROW", 0, "COPY"), ("NEW_ARRAY", 0, "EXP"),
)


#: Edges between call-graph nodes ``sm`` and ``dm``; entries and exits of callees are labelled with the site.
CROSSING = ("sm", "src", "dm", "dst", "type", "label_type", "label_id", "receivers")


def within(edges: DataFrame) -> DataFrame:
    """Edges (m, src, dst, type) as ``CROSSING``."""
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    return edges.select(F.col("m").alias("sm"), F.col("src").cast("string").alias("src"), F.col("m").alias("dm"), F.col("dst").cast("string").alias("dst"), "type", null("string", "label_type"), null("long", "label_id"), null("array<long>", "receivers"))


def crossing(d: DataFrame, sm: Column, src: Column, dm: Column, dst: Column, kind: str, label: str) -> DataFrame:
    return d.select(sm.alias("sm"), src.alias("src"), dm.alias("dm"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(label).alias("label_type"), F.col("site").cast("long").alias("label_id"), "receivers")


def node_id(m: Column, key: Column) -> Column:
    """Identity of a node by its call-graph node and its key there, which names its kind as well."""
    return F.xxhash64(m, key)


def data_edges(instr: DataFrame) -> DataFrame:
    """(m, iid, src, dst, type): from operands to results; instructions without a result have their own node."""
    table = F.broadcast(instr.sparkSession.createDataFrame(list(DATA_EDGES), "op string, pos int, type string"))
    hit = instr.join(table, "op").withColumn("src", F.get("uses", F.col("pos"))).where("src is not null")
    return hit.select("m", "iid", "src", F.coalesce("def", "iid").alias("dst"), "type").distinct()


def implicit_edges(instr: DataFrame, pc: DataFrame) -> DataFrame:
    """(m, iid, src, dst, type): from the program counter (m, bb, pc) of a block to all that its instructions define."""
    return instr.join(pc, ["m", "bb"]).select("m", "iid", F.col("pc").alias("src"), F.coalesce("def", "iid").alias("dst"), F.lit("IMPLICIT").alias("type"))


def exception_split(raised: DataFrame, pc: DataFrame) -> DataFrame:
    """Edges of instructions (m, bb, iid, type) that may raise: the counter splits, and the exception depends on both."""
    r = raised.select("m", "bb", "iid").distinct().join(pc, ["m", "bb"])
    side = lambda k, t: r.select("m", "iid", F.col("pc").cast("string").alias("src"), F.concat(F.lit(k), "iid").alias("dst"), F.lit(t).alias("type"))
    made = raised.select("m", "iid", F.concat(F.lit("T"), "iid").alias("src"), F.concat(F.lit("X"), "iid", F.lit(":"), "type").alias("dst"), F.lit("IMPLICIT").alias("type"))
    return union_all([side("T", "TRUE"), side("F", "FALSE"), made]).distinct()


def phi_edges(phi: DataFrame, ways: DataFrame) -> DataFrame:
    """Operand i of a phi (m, bb, def, uses) comes from predecessor i: COPY to a temporary under the counter of the way
    from there (m, bb, pred, pc), MERGE into the phi, COPY to the result."""
    ranked = ways.select("m", "bb", "pred", "pc").withColumn("i", F.dense_rank().over(W.partitionBy("m", "bb").orderBy("pred")) - 1)
    ops = phi.select("m", "bb", "def", F.posexplode("uses").alias("i", "v")).join(ranked, ["m", "bb", "i"])
    temp, merge = F.concat(F.lit("t"), "def", F.lit(":"), "i"), F.concat(F.lit("m"), "def")
    edge = lambda s, d, t: ops.select("m", s.cast("string").alias("src"), d.cast("string").alias("dst"), F.lit(t).alias("type"))
    return union_all([edge(F.col("v"), temp, "COPY"), edge(F.col("pc"), temp, "IMPLICIT"), edge(temp, merge, "MERGE"), edge(merge, F.col("def"), "COPY")]).distinct()


def branch_edges(branches: DataFrame, pc: DataFrame) -> DataFrame:
    """Edges of branches (m, bb, iid, operator, u0, u1, zero): a condition node, its two counters, and the conjunctions.

    ``v != 0`` and ``v == 0`` (``zero``) need no condition node: the value is the condition, turned round for ``==``.
    """
    b = branches.join(pc, ["m", "bb"])
    turned = F.col("zero") & (F.col("operator") == "EQ")
    cond = F.when(F.col("zero"), F.col("u0").cast("string")).otherwise(F.concat(F.lit("c"), "iid"))
    edge = lambda d, s, t, ty: d.select("m", s.cast("string").alias("src"), t.cast("string").alias("dst"), ty.alias("type"))
    yes, no = F.concat(F.lit("T"), "iid"), F.concat(F.lit("F"), "iid")
    plain = b.where("not zero")
    return union_all([
        edge(plain, F.col("u0"), cond, F.lit("EXP")), edge(plain, F.col("u1"), cond, F.lit("EXP")),
        edge(b, cond, yes, F.when(turned, "FALSE").otherwise("TRUE")), edge(b, cond, no, F.when(turned, "TRUE").otherwise("FALSE")),
        edge(b, F.col("pc"), yes, F.lit("CONJUNCTION")), edge(b, F.col("pc"), no, F.lit("CONJUNCTION")),
    ]).distinct()


def switch_edges(switches: DataFrame, pc: DataFrame) -> DataFrame:
    """All cases of a switch (m, bb, iid, u0) share one counter node."""
    s = switches.join(pc, ["m", "bb"])
    edge = lambda c, t: s.select("m", F.col(c).cast("string").alias("src"), F.concat(F.lit("s"), "iid").alias("dst"), F.lit(t).alias("type"))
    return edge("u0", "SWITCH").union(edge("pc", "CONJUNCTION"))


def call_edges(sites: DataFrame, actual: DataFrame, call_edge: DataFrame, arity: DataFrame, receivers: DataFrame | None = None) -> DataFrame:
    """Edges (``CROSSING``) of calls: arguments are assigned under the site's counter, and enter the callee's summary
    nodes with the counter itself, labelled with the site.

    ``sites`` is (m, site, pc), ``actual`` (site, i, v), ``call_edge`` (site, callee), ``arity`` (m, i) the formals there
    are. ``receivers`` (site, callee, heap) is given for calls on maps only and tells the labels apart.
    """
    target = call_edge.select("site", "callee").distinct()
    if receivers is not None:
        target = target.join(receivers.groupBy("site", "callee").agg(F.sort_array(F.collect_set("heap")).alias("receivers")), ["site", "callee"], "left")
    else:
        target = target.withColumn("receivers", F.lit(None).cast("array<long>"))
    args = sites.join(actual.select("site", "i", "v"), "site")
    assigned = F.concat(F.lit("a"), "site", F.lit(":"), "i")
    given = args.join(target, "site").join(arity.select(F.col("m").alias("callee"), "i"), ["callee", "i"])
    return union_all([
        within(args.select("m", F.col("v").cast("string").alias("src"), assigned.alias("dst"), F.lit("COPY").alias("type"))), within(args.select("m", F.col("pc").alias("src"), assigned.alias("dst"), F.lit("IMPLICIT").alias("type"))),
        crossing(given, F.col("m"), assigned, F.col("callee"), F.concat(F.lit("f"), "i"), "MERGE", "ENTRY"), crossing(sites.join(target, "site"), F.col("m"), F.col("pc"), F.col("callee"), F.lit("entry"), "MERGE", "ENTRY"),
    ])


def exit_edges(sites: DataFrame, call_edge: DataFrame, exits: DataFrame, receivers: DataFrame | None = None) -> DataFrame:
    """Edges (``CROSSING``) from the exits that callees take (m, kind) back to their sites (m, site, kind, pc, result).

    Each callee's exit has a join of the site's counter with its own, and an assignment of its value; several are merged.
    Where no callee takes the exit, one made node stands for each. ``result`` null: the call has no value.
    """
    target = call_edge.select("site", "callee").distinct().join(exits.select(F.col("m").alias("callee"), "kind").distinct(), "callee")
    if receivers is not None:
        target = target.join(receivers.groupBy("site", "callee").agg(F.sort_array(F.collect_set("heap")).alias("receivers")), ["site", "callee"], "left")
    else:
        target = target.withColumn("receivers", F.lit(None).cast("array<long>"))
    n = target.groupBy("site", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("callee").alias("only"))
    each = sites.join(target, ["site", "kind"])
    one = sites.join(n, ["site", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    at = lambda k: F.concat(F.lit(k), "kind", "site")
    join, value = F.concat(at("e"), F.lit(":"), "callee"), F.concat(at("r"), F.lit(":"), "callee")
    merged = lambda k: F.when(F.col("n") == 0, at(k)).when(F.col("n") == 1, F.concat(at(k), F.lit(":"), "only")).otherwise(F.concat(at(k), F.lit(":m")))
    edge = lambda d, s, t, ty: within(d.select("m", s.alias("src"), t.alias("dst"), F.lit(ty).alias("type")))
    many = each.join(n.where("n > 1").select("site", "kind", "n"), ["site", "kind"]).withColumn("only", F.lit(None).cast("long"))
    valued = lambda d: d.where("result is not null")
    return union_all([
        edge(each, F.col("pc"), join, "CONJUNCTION"), crossing(each, F.col("callee"), F.concat(F.lit("pc"), "kind"), F.col("m"), join, "CONJUNCTION", "EXIT"),
        edge(valued(each), join, value, "IMPLICIT"), crossing(valued(each), F.col("callee"), F.concat(F.lit("out"), "kind"), F.col("m"), value, "COPY", "EXIT"),
        edge(many, join, merged("e"), "MERGE"), edge(valued(many), value, merged("r"), "MERGE"),
        edge(one.where("n = 0"), F.col("pc"), at("e"), "CONJUNCTION"), edge(one, merged("e"), at("j"), "CONJUNCTION"),
        edge(valued(one.where("n = 0")), at("j"), at("r"), "IMPLICIT"), edge(valued(one), merged("r"), F.col("result"), "COPY"),
    ])


def native_edges(native: DataFrame, formal: DataFrame, exits: DataFrame) -> DataFrame:
    """Formals of native methods reach their results in an unknown way."""
    n = formal.join(native.select("m"), "m", "left_semi").join(exits.withColumnRenamed("v", "out"), "m")
    return n.select(F.col("v").cast("string").alias("src"), F.col("out").cast("string").alias("dst"), F.lit("MISSING").alias("type")).distinct()


def inline_models(calls: DataFrame, wrapper_types: DataFrame) -> DataFrame:
    """Calls (site, t, name, uses, result) on immutable wrappers and array copies, as plain EXP edges to the result or target."""
    pure = calls.join(wrapper_types, "t", "left_semi").select("site", F.explode("uses").alias("src"), F.coalesce("result", "site").alias("dst"))
    copy = calls.where("name = 'arraycopy'").select("site", F.get("uses", F.lit(0)).alias("src"), F.get("uses", F.lit(2)).alias("dst"))
    return pure.union(copy).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("EXP").alias("type")).distinct()


def restore_pc(dom: DataFrame, post: DataFrame, merges: DataFrame) -> DataFrame:
    """(m, bb, at): a merge point runs under the counter of the nearest dominator that it post-dominates, if one is."""
    cand = merges.join(dom, ["m", "bb"]).where("dom <> bb").join(post.select("m", F.col("bb").alias("dom"), F.col("dom").alias("bb")), ["m", "dom", "bb"], "left_semi")
    above = dom.where("dom <> bb").select("m", F.col("bb").alias("dom"), F.col("dom").alias("outer"))
    outer = cand.join(above, ["m", "dom"]).select("m", "bb", F.col("outer").alias("dom"))
    nearest = cand.join(outer, ["m", "bb", "dom"], "left_anti")
    return nearest.groupBy("m", "bb").agg(F.count(F.lit(1)).alias("n"), F.min("dom").alias("at")).where("n = 1").select("m", "bb", "at")


def merge_nodes(incoming: DataFrame) -> DataFrame:
    """(m, bb, kind, sources): blocks where several return, exception or counter nodes (m, bb, kind, node) meet."""
    met = incoming.groupBy("m", "bb", "kind").agg(F.sort_array(F.collect_set("node")).alias("sources"))
    return met.where(F.size("sources") > 1)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, type, n): nodes and edges by type, and their totals (type null)."""
    each = lambda d, k: d.distinct().rollup("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "type", "n")
    return each(nodes.select("id", "type"), "node").union(each(edges.select("src", "dst", "type"), "edge"))


def subgraph(nodes: DataFrame, edges: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the ``methods`` (grp) and their neighbours, with the edges that touch those methods."""
    own = nodes.join(methods, "grp", "left_semi").select("id")
    touch = edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")).distinct()
    ids = own.union(touch.select("src")).union(touch.select("dst")).distinct()
    return nodes.join(ids, "id", "left_semi"), touch
