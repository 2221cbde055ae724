"""The dependence graph of a whole program: counters of blocks, the edges of every method, and summaries that tie them.

A node is a call-graph node ``m`` (a method, or the number of a method and context) and a key: a value's number, or a
letter and a number for what has no value of its own:

=========  ========================================  ==========  =======================================
``T F``    true and false counters of an instruction  ``s``       counter of all cases of a switch
``p``      counter where ways meet                   ``entry``   counter that callers hand over
``X xm``   generated exception, exceptions that meet ``x``       exception that a call throws
``t m c``  operand of a phi, phi, condition          ``a f``     argument of a call, formal of a method
``e j``    counter of one exit, after the call       ``r``       value of one exit
``pcN/E``  counters at the exits                     ``outN/E``  values at the exits
=========  ========================================  ==========  =======================================

An instruction that splits the counter (branch, switch, call, one that may raise) is the last of its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import pdg as G
from lattica.operators.dataflow import dominators
from lattica.operators.fixpoint import RoundLimit, counted, settle, union_all

#: Instructions whose result is not simply computed under the block's counter.
OWN_RULES = ("CONDITIONAL_BRANCH", "SWITCH", "GOTO", "PHI", "GET_CAUGHT_EXCEPTION", "INVOKE_INTERFACE", "INVOKE_SPECIAL", "INVOKE_STATIC", "INVOKE_VIRTUAL")
#: Kind of a node by what its key starts with, the longest that fits.
KINDS = {
    "entry": "ENTRY_PC_SUMMARY", "pcN": "EXIT_PC_SUMMARY", "pcE": "EXIT_PC_SUMMARY", "outN": "EXIT_SUMMARY", "outE": "EXIT_SUMMARY", "T": "BOOLEAN_TRUE_PC", "F": "BOOLEAN_FALSE_PC", "s": "PC_OTHER", "p": "PC_MERGE",
    "X": "BASE_VALUE", "xm": "OTHER_EXPRESSION", "x": "LOCAL", "t": "OTHER_EXPRESSION", "m": "OTHER_EXPRESSION", "c": "OTHER_EXPRESSION", "a": "FORMAL_ASSIGNMENT", "f": "FORMAL_SUMMARY", "e": "EXIT_PC_JOIN", "j": "PC_OTHER", "r": "EXIT_ASSIGNMENT",
}
COUNTERS = ("ENTRY_PC_SUMMARY", "EXIT_PC_SUMMARY", "BOOLEAN_TRUE_PC", "BOOLEAN_FALSE_PC", "PC_OTHER", "PC_MERGE", "EXIT_PC_JOIN")


def node_kind(key: Column) -> Column:
    start = F.regexp_extract(key, "^(entry|pcN|pcE|outN|outE|xm|[A-Za-z])", 1)
    found = F.lit("LOCAL")
    for k, kind in KINDS.items():
        found = F.when(start == k, kind).otherwise(found)
    return found


def ways_out(edges: DataFrame, instr: DataFrame, raised: DataFrame) -> DataFrame:
    """(m, src, dst, kind, out, exc): edges (m, src, dst, kind, branch) with the counter that they carry, null for the
    block's own, and the exception that travels along them."""
    last = instr.groupBy("m", "bb").agg(F.max_by(F.struct("op", "iid", "def"), "idx").alias("l")).select("m", F.col("bb").alias("src"), "l.*")
    thrown = raised.select("m", F.col("bb").alias("src"), F.concat(F.lit("X"), "iid", F.lit(":"), "type").alias("x")).groupBy("m", "src").agg(F.collect_set("x").alias("x"))
    op, exceptional, call = F.col("op"), F.col("kind") == "E", F.col("op").startswith("INVOKE")
    name = lambda k: F.concat(F.lit(k), "iid")
    out = F.when(op == "CONDITIONAL_BRANCH", F.when(F.col("branch") == "T", name("T")).otherwise(name("F"))).when(op == "SWITCH", name("s")).when(call, F.concat(F.lit("j"), "kind", "iid"))
    out = out.when(F.col("x").isNotNull(), F.when(exceptional, name("T")).otherwise(name("F")))
    exc = F.when(exceptional, F.when(call, F.array(name("x"))).when(op == "THROW", F.array(F.col("def").cast("string"))).otherwise(F.col("x")))
    return edges.join(last, ["m", "src"], "left").join(thrown, ["m", "src"], "left").select("m", "src", "dst", "kind", out.alias("out"), exc.alias("exc"))


def counters(ways: DataFrame, entry: DataFrame, restored: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """The counter (m, bb, pc) of every block, and the blocks (m, bb) where ways meet under a counter of their own.

    A block that one way leads to takes what that way carries; a ``restored`` one (m, bb, at) the counter of block ``at``.
    Blocks point to blocks above them, so the pointers are followed by doubling.
    """
    met = ways.groupBy("m", F.col("dst").alias("bb")).agg(F.count_distinct(F.coalesce("out", F.col("src").cast("string"))).alias("n"), F.min("out").alias("out"), F.min("src").alias("src"))
    blocks = met.join(restored, ["m", "bb"], "left").join(entry.select("m", "bb", F.lit(True).alias("first")), ["m", "bb"], "full_outer")
    own = F.when(F.col("first"), F.lit("entry")).when(F.col("at").isNotNull(), F.lit(None)).when(F.col("n") == 1, F.col("out")).otherwise(F.concat(F.lit("p"), "bb"))
    state, _ = counted(blocks.select("m", "bb", own.alias("pc"), F.coalesce("at", "src").alias("at"), (F.col("first").isNull() & F.col("at").isNull() & (F.col("n") > 1)).alias("merge")))
    merges = state.where("merge").select("m", "bb")
    done, (left, n) = [state.where("pc is not null").select("m", "bb", "pc")], counted(state.where("pc is null").select("m", "bb", "at"))
    for _ in range(most_rounds):
        if not n:
            return union_all(done), merges
        above = union_all([*[d.select("m", F.col("bb").alias("at"), "pc", F.lit(None).cast("long").alias("up")) for d in done], left.select("m", F.col("bb").alias("at"), F.lit(None).cast("string").alias("pc"), F.col("at").alias("up"))])
        moved = settle(left.join(above, ["m", "at"]).select("m", "bb", "pc", F.coalesce("up", "at").alias("at")))
        done.append(moved.where("pc is not null").select("m", "bb", "pc"))
        left, n = counted(moved.where("pc is null").select("m", "bb", "at"))
    raise RoundLimit(f"counters did not settle in {most_rounds} rounds")


def summary_edges(formal: DataFrame, into: DataFrame, exits: DataFrame, returns: DataFrame) -> DataFrame:
    """Edges of a method's summary: formals (m, i, v), counters and exceptions of the ways ``into`` (m, src, dst, kind, pc,
    exc) the exit block, and the values of ``returns`` (m, bb, v)."""
    last = settle(into.join(exits.select("m", F.col("bb").alias("dst")), ["m", "dst"]))
    edge = lambda d, s, t, ty: d.select("m", s.cast("string").alias("src"), t.alias("dst"), F.lit(ty).alias("type"))
    back = last.where("kind = 'N'").join(returns.select("m", F.col("bb").alias("src"), "v"), ["m", "src"])
    return union_all([
        edge(formal, F.concat(F.lit("f"), "i"), F.col("v").cast("string"), "COPY"), edge(last, F.col("pc"), F.concat(F.lit("pc"), "kind"), "MERGE"),
        edge(last.select("m", F.explode("exc").alias("x")), F.col("x"), F.lit("outE"), "MERGE"), edge(back, F.col("v"), F.lit("outN"), "MERGE"),
    ])


def whole(p: dict[str, DataFrame], receivers: DataFrame | None = None) -> DataFrame:
    """Edges (``pdg.CROSSING``) of the program ``p``, over blocks that execution may reach.

    ``p`` holds instr (m, bb, idx, iid, op, def, uses, operator, zero), edges (m, src, dst, kind, branch), entry and exit
    (m, bb), raised (m, bb, iid, type), call_edge (site, callee), formal (m, i, v); a call's site is its instruction.
    """
    dom, post = settle(dominators(p["edges"], p["entry"])), settle(dominators(p["edges"], p["exit"], post=True))
    live = dom.where("bb = dom").select("m", "bb")
    instr = settle(p["instr"].join(live, ["m", "bb"]))
    edges = p["edges"].join(live.withColumnRenamed("bb", "src"), ["m", "src"])
    raised = p["raised"].join(live, ["m", "bb"], "left_semi").select("m", "bb", "iid", "type")
    ways = settle(ways_out(edges, instr, raised))
    joins = ways.groupBy("m", F.col("dst").alias("bb")).agg(F.count_distinct(F.coalesce("out", F.col("src").cast("string"))).alias("n")).where("n > 1")
    pc, merges = counters(ways, p["entry"], G.restore_pc(dom, post, joins.select("m", "bb")))
    pc = settle(pc)
    ways = settle(ways.join(pc.withColumnRenamed("bb", "src"), ["m", "src"]).select("m", "src", "dst", "kind", "exc", F.coalesce("out", "pc").alias("pc")))

    into = ways.select("m", F.col("dst").alias("bb"), F.explode("exc").alias("node"), F.lit("exc").alias("kind")).join(p["exit"], ["m", "bb"], "left_anti")
    met = settle(G.merge_nodes(into).select("m", "bb", F.explode("sources").alias("node")))
    several = met.select("m", "bb").distinct()
    here = into.join(several, ["m", "bb"], "left_anti").select("m", "bb", "node").unionByName(several.select("m", "bb", F.concat(F.lit("xm"), "bb").alias("node"))).distinct()
    caught = instr.where("op = 'GET_CAUGHT_EXCEPTION'").select("m", "bb", F.col("def").cast("string").alias("v")).join(here, ["m", "bb"])

    local = lambda d, s, t, ty: d.select("m", F.col(s).cast("string").alias("src"), t.alias("dst"), F.lit(ty).alias("type"))
    meet = ways.select("m", F.col("dst").alias("bb"), "pc").join(merges, ["m", "bb"]).join(p["exit"], ["m", "bb"], "left_anti")
    computed = instr.where(~F.col("op").isin(*OWN_RULES))
    calls = instr.where(F.col("op").startswith("INVOKE")).join(pc, ["m", "bb"]).select("m", F.col("iid").alias("site"), "pc", "uses", "def")
    inner = [G.data_edges(instr), G.implicit_edges(computed, pc), G.exception_split(raised, pc), G.phi_edges(instr.where("op = 'PHI'"), ways.select("m", F.col("dst").alias("bb"), F.col("src").alias("pred"), "pc"))]
    inner += [G.branch_edges(instr.where("op = 'CONDITIONAL_BRANCH'").select("m", "bb", "iid", "operator", F.get("uses", F.lit(0)).alias("u0"), F.get("uses", F.lit(1)).alias("u1"), "zero"), pc)]
    inner += [G.switch_edges(instr.where("op = 'SWITCH'").select("m", "bb", "iid", F.get("uses", F.lit(0)).alias("u0")), pc)]
    inner += [local(meet, "pc", F.concat(F.lit("p"), "bb"), "MERGE"), local(met, "node", F.concat(F.lit("xm"), "bb"), "MERGE"), local(caught, "node", F.col("v"), "COPY")]
    inner += [summary_edges(p["formal"], ways, p["exit"], instr.where("op = 'RETURN'").select("m", "bb", F.col("def").alias("v")))]
    taken = ways.join(p["exit"].withColumnRenamed("bb", "dst"), ["m", "dst"], "left_semi").select("m", "kind").distinct()
    back = calls.select("m", "site", "pc", F.lit("N").alias("kind"), F.col("def").cast("string").alias("result")).unionByName(calls.select("m", "site", "pc", F.lit("E").alias("kind"), F.concat(F.lit("x"), "site").alias("result")))
    outer = [G.call_edges(calls, calls.select("site", F.posexplode("uses").alias("i", "v")), p["call_edge"], p["formal"], receivers), G.exit_edges(back, p["call_edge"], taken, receivers)]
    return union_all([*[G.within(e) for e in inner], *outer]).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """(id, m, key, type): all nodes of ``edges``. Two nodes with one identity are an error, never one node."""
    found = edges.select(F.col("sm").alias("m"), F.col("src").alias("key")).union(edges.select("dm", "dst")).distinct()
    found = settle(found.select(G.node_id(F.col("m"), F.col("key")).alias("id"), "m", "key", node_kind(F.col("key")).alias("type")))
    twice = found.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two nodes share the identity {twice[0]['id']}")
    return found
