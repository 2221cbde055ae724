"""Transfer functions of the client analyses, opcode by opcode, as projections.

Input rows are instructions joined with the facts of their operands; output rows are facts for the normal ('N') or the
exceptional ('E') edge. Values: two-bit booleans, intervals, non-nullness, exception types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import lattices as L
from lattica.operators.fixpoint import rise, settle, union_all
from lattica.operators.register import implicit_table

# --- boolean constants -----------------------------------------------------------------------------------------


def bool_binary(rows: DataFrame) -> DataFrame:
    """(iid, value) of and/or/xor rows (iid, op, a, b) with two-bit operands."""
    v = F.when(F.col("op") == "and", L.bool_op("and", F.col("a"), F.col("b"))).when(F.col("op") == "or", L.bool_op("or", F.col("a"), F.col("b"))).otherwise(L.bool_op("xor", F.col("a"), F.col("b")))
    return rows.select("iid", v.cast("int").alias("value"))


def bool_comparison(rows: DataFrame) -> DataFrame:
    """(iid, value): the same value number compares equal; two constants by their values; else unknown."""
    equal = F.when(F.col("u0") == F.col("u1"), L.TRUE).when(F.col("c0").isNotNull() & F.col("c1").isNotNull(), F.when(F.col("c0") == F.col("c1"), L.TRUE).otherwise(L.FALSE)).otherwise(L.UNKNOWN)
    return rows.select("iid", equal.cast("int").alias("value"))


def bool_instanceof(tests: DataFrame, pts: DataFrame, heap_type: DataFrame, subtype: DataFrame, null_const: DataFrame, compat: bool = False) -> DataFrame:
    """(iid, value) of tests (m, iid, v, type): all pointees assignable, none, or unknown; without pointees unknown.

    A null constant is not an instance of anything; with ``compat`` it is taken for one of everything.
    """
    kinds = tests.join(pts, "v").join(heap_type, "heap")
    ok = subtype.select(F.col("sup").alias("type"), F.col("sub").alias("t"), F.lit(True).alias("ok"))
    seen = kinds.join(ok, ["type", "t"], "left").groupBy("iid").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all"), F.bool_or(F.coalesce("ok", F.lit(False))).alias("any"))
    nulls = null_const.select("m", "v", F.lit(True).alias("is_null")).distinct()
    v = F.when(F.col("is_null"), L.TRUE if compat else L.FALSE).when(F.col("all"), L.TRUE).when(~F.col("any"), L.FALSE).otherwise(L.UNKNOWN)
    return tests.join(nulls, ["m", "v"], "left").join(seen, "iid", "left").select("iid", v.cast("int").alias("value"))


def bool_phi(uses: DataFrame) -> DataFrame:
    """(m, def, value): join of a phi's operands (m, def, value)."""
    return uses.groupBy("m", "def").agg(L.join_bool("value").alias("value"))


def bool_branch(rows: DataFrame) -> DataFrame:
    """(m, bb, v, taken, value): what ``v == 0`` and ``v != 0`` branches (m, bb, v, operator) tell on both successors."""
    both = rows.where(F.col("operator").isin("EQ", "NE")).withColumn("taken", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.select("m", "bb", "v", "taken", F.when((F.col("operator") == "EQ") == F.col("taken"), L.FALSE).otherwise(L.TRUE).alias("value"))


def bool_local(values: DataFrame, const: DataFrame) -> DataFrame:
    """(m, v, value): known values, else literals 1 and 0, else unknown."""
    c = const.where("kind = 'num'").select("m", "v", F.when(F.col("dval") == 1, L.TRUE).when(F.col("dval") == 0, L.FALSE).otherwise(L.UNKNOWN).alias("lit"))
    return values.join(c, ["m", "v"], "left").select("m", "v", F.coalesce("value", "lit", F.lit(L.UNKNOWN)).cast("int").alias("value"))


def bool_results(values: DataFrame) -> DataFrame:
    """(iid, v, is_true, is_constant) of recorded values."""
    return values.select("iid", "v", (F.col("value") == L.TRUE).alias("is_true"), F.col("value").isin(L.TRUE, L.FALSE).alias("is_constant"))


# --- non-null values: true at the bottom -----------------------------------------------------------------------

#: Opcodes after which their first operand is known not to be null, and those whose result never is.
DEREFERENCES = ("ARRAY_LENGTH", "ARRAY_LOAD", "ARRAY_STORE", "GET_FIELD", "PUT_FIELD", "MONITOR", "INVOKE_VIRTUAL", "INVOKE_INTERFACE", "INVOKE_SPECIAL", "THROW")
NEVER_NULL = ("NEW_OBJECT", "NEW_ARRAY", "LOAD_METADATA", "GET_CAUGHT_EXCEPTION")


def nonnull_transfer(instr: DataFrame) -> DataFrame:
    """(m, bb, iid, v, kind, nonnull): what an instruction says about values on its normal and exceptional edges."""
    base = F.get("uses", F.lit(0))
    used = instr.where(F.col("op").isin(*DEREFERENCES) & base.isNotNull())
    normal = used.select("m", "bb", "iid", base.alias("v"), F.lit("N").alias("kind"), F.lit(True).alias("nonnull"))
    failed = used.select("m", "bb", "iid", base.alias("v"), F.lit("E").alias("kind"), F.lit(False).alias("nonnull"))
    made = instr.where(F.col("op").isin(*NEVER_NULL)).select("m", "bb", "iid", F.col("def").alias("v"), F.lit("N").alias("kind"), F.lit(True).alias("nonnull"))
    cast = instr.where("op = 'CHECK_CAST'").select("m", "bb", "iid", base.alias("v"), F.lit("E").alias("kind"), F.lit(True).alias("nonnull"))
    return union_all([normal, failed, made, cast])


def nonnull_branch(rows: DataFrame) -> DataFrame:
    """(m, bb, v, taken, nonnull) for comparisons (m, bb, operator, v) with null: four cases."""
    both = rows.where(F.col("operator").isin("EQ", "NE")).withColumn("taken", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.select("m", "bb", "v", "taken", ((F.col("operator") == "NE") == F.col("taken")).alias("nonnull"))


def nonnull_phi(uses: DataFrame) -> DataFrame:
    return uses.groupBy("m", "def").agg(F.bool_and("nonnull").alias("nonnull"))


def nonnull_call(actual: DataFrame, call_edge: DataFrame, formal: DataFrame) -> DataFrame:
    """(m, v, nonnull): formals, non-null if the argument is at every call site. ``actual`` is (site, i, nonnull)."""
    hit = actual.join(call_edge.select("site", F.col("callee").alias("m")).distinct(), "site").join(formal, ["m", "i"])
    return hit.groupBy("m", "v").agg(F.bool_and("nonnull").alias("nonnull"))


def nonnull_return(call_edge: DataFrame, returned: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, nonnull): results, non-null if they are from every callee; calls without callee may give null."""
    hit = sites.join(call_edge.select("site", F.col("callee").alias("m")), "site", "left").join(returned, "m", "left")
    return hit.groupBy("site").agg(F.bool_and(F.coalesce("nonnull", F.lit(False))).alias("nonnull"))


def nonnull_query(asked: DataFrame, known: DataFrame, const: DataFrame, primitive: DataFrame, this: DataFrame) -> DataFrame:
    """(m, iid, v, nonnull): null constants no, primitives, other constants and ``this`` yes, others as recorded."""
    a = asked.join(const.select("m", "v", F.col("kind").alias("ck")), ["m", "v"], "left")
    a = a.join(primitive.select("m", "v", F.lit(True).alias("p")), ["m", "v"], "left").join(this.select("m", "v", F.lit(True).alias("t")), ["m", "v"], "left")
    a = a.join(known.select("m", "iid", "v", F.col("nonnull").alias("k")), ["m", "iid", "v"], "left")
    value = F.when(F.col("ck") == "null", False).when(F.col("ck").isNotNull() | F.col("p") | F.col("t"), True).otherwise(F.coalesce("k", F.lit(False)))
    return a.select("m", "iid", "v", value.alias("nonnull"))


# --- intervals -------------------------------------------------------------------------------------------------


def interval_arithmetic(rows: DataFrame) -> DataFrame:
    """(iid, value) of rows (iid, op, a, b) with interval operands; shifts have no value."""
    return rows.select("iid", L.arithmetic(F.col("op"), F.col("a"), F.col("b")).alias("value"))


def interval_branch(rows: DataFrame) -> DataFrame:
    """(m, bb, v, taken, value): refinement of rows (m, bb, v, operator, value, bound); strictness is not told apart."""
    both = rows.withColumn("taken", F.explode(F.array(F.lit(True), F.lit(False))))
    o, t, v, n = F.col("operator"), F.col("taken"), F.col("value"), F.col("bound")
    up, down = o.isin("GE", "GT"), o.isin("LE", "LT")
    refined = (
        F.when((o == "EQ") & t | (o == "NE") & ~t, L.point(n)).when(up & t | down & ~t, L.at_least(v, n)).when(down & t | up & ~t, L.at_most(v, n)).otherwise(v)
    )
    return both.select("m", "bb", "v", "taken", refined.alias("value"))


def interval_division(rows: DataFrame) -> DataFrame:
    """(m, bb, iid, v, kind, value): a division that failed had a divisor of zero."""
    return rows.select("m", "bb", "iid", "v", F.lit("E").alias("kind"), L.point(F.lit(0.0)).alias("value"))


def interval_phi(uses: DataFrame) -> DataFrame:
    return uses.groupBy("m", "def").agg(L.join_interval("value").alias("value"))


def interval_default(values: DataFrame, const: DataFrame) -> DataFrame:
    """(m, v, value): known intervals, else numeric constants as points, else bottom (null)."""
    c = const.where("kind = 'num'").select("m", "v", L.point(F.col("dval")).alias("lit"))
    return values.join(c, ["m", "v"], "left").select("m", "v", F.coalesce("value", "lit").alias("value"))


def interval_heap(stores: DataFrame, news: DataFrame) -> DataFrame:
    """(loc, value): weak updates of stores (loc, value) joined with zero for the fields of new objects (loc)."""
    zero = news.select("loc", L.point(F.lit(0.0)).alias("value"))
    return stores.select("loc", "value").unionByName(zero).groupBy("loc").agg(L.join_interval("value").alias("value"))


def interval_loop(seed: DataFrame, edges: DataFrame, add: float = 1.0) -> DataFrame:
    """(m, bb, slot, value): a counter that grows by ``add`` in every block; widening makes it end."""
    from lattica.operators.dataflow import solve_blocks

    def transfer(d: DataFrame) -> DataFrame:
        return d.withColumn("value", L.arithmetic(F.lit("ADD"), F.col("value"), L.point(F.lit(add))))

    return solve_blocks(edges, seed, {"value": L.join_interval}, transfer)


def project_accessible(facts: DataFrame, access: DataFrame, native: DataFrame) -> DataFrame:
    """Heap facts (callee, loc, value) that a callee may touch; native code touches none."""
    kept = facts.join(access.select(F.col("m").alias("callee"), "loc"), ["callee", "loc"], "left_semi")
    return kept.join(native.select(F.col("m").alias("callee")), "callee", "left_anti")


# --- precise exceptions ----------------------------------------------------------------------------------------


def implicit_exceptions(instr: DataFrame, nonnull: DataFrame) -> DataFrame:
    """(m, bb, iid, type): what the virtual machine may raise, without null errors of non-null operands (iid)."""
    raised = instr.select("m", "bb", "iid", "op").join(implicit_table(instr), "op").select("m", "bb", "iid", F.col("type_name").alias("type"))
    safe = nonnull.select("iid", F.lit("NullPointerException").alias("type"))
    return raised.join(safe, ["iid", "type"], "left_anti").select("m", "bb", "iid", "type")


def call_exceptions(call_edge: DataFrame, thrown: DataFrame, receiver_safe: DataFrame) -> DataFrame:
    """(m, type): what leaves each procedure: its own (m, type) and its callees', to a fixpoint.

    Calls whose receiver is non-null (caller, callee) do not pass on null errors.
    """
    from lattica.operators.fixpoint import grow

    safe = receiver_safe.select("caller", "callee", F.lit("NullPointerException").alias("type"))

    def up(d):
        hit = d["x"].join(call_edge.select("caller", "callee"), d["x"]["m"] == call_edge["callee"]).select("caller", "callee", "type")
        return hit.join(safe, ["caller", "callee", "type"], "left_anti").select(F.col("caller").alias("m"), "type")

    return grow({"x": thrown.select("m", "type")}, lambda d, t: {"x": [up(d)]})["x"]


def missing_receiver(calls: DataFrame, call_edge: DataFrame, declared: DataFrame) -> DataFrame:
    """(site, type) of calls without callee: RuntimeException and what the target declares."""
    lost = calls.join(call_edge.select("site"), "site", "left_anti").select("site", "target")
    return lost.select("site", F.lit("RuntimeException").alias("type")).union(lost.join(declared.select(F.col("m").alias("target"), "type"), "target").select("site", "type")).distinct()


def drop_by_constants(raised: DataFrame, facts: DataFrame) -> DataFrame:
    """Exceptions that constants rule out. ``facts`` is (iid, idx, dim, divisor, dims array<double>), null if unknown."""
    j = raised.join(facts, "iid", "left")
    index = (F.col("type") == "ArrayIndexOutOfBoundsException") & (F.col("idx") >= 0) & (F.col("idx") < F.col("dim"))
    divided = (F.col("type") == "ArithmeticException") & (F.col("divisor") != 0)
    sized = (F.col("type") == "NegativeArraySizeException") & F.forall("dims", lambda d: d >= 0)
    return j.where(~F.coalesce(index, F.lit(False)) & ~F.coalesce(divided, F.lit(False)) & ~F.coalesce(sized, F.lit(False))).select(*raised.columns)


def removable_casts(casts: DataFrame, pts: DataFrame, heap_type: DataFrame, subtype: DataFrame, null_const: DataFrame) -> DataFrame:
    """(iid) of casts (m, iid, v, type) that cannot fail: every pointee is assignable, or the value is null."""
    kinds = casts.join(pts, "v").join(heap_type, "heap")
    bad = kinds.join(subtype.select(F.col("sup").alias("type"), F.col("sub").alias("t")), ["type", "t"], "left_anti").select("iid")
    good = casts.join(pts.select("v").distinct(), "v", "left_semi").join(bad, "iid", "left_anti").select("iid")
    return good.union(casts.join(null_const, ["m", "v"], "left_semi").select("iid")).distinct()


#: Widening conversions between primitive types.
WIDENING = {"B": "SIJFD", "S": "IJFD", "C": "IJFD", "I": "JFD", "J": "FD", "F": "D"}


def safe_array_stores(stores: DataFrame, subtype: DataFrame, null_const: DataFrame) -> DataFrame:
    """(iid) of stores (m, iid, v, elem, given) that cannot fail: null, a widening primitive or an assignable type."""
    spark = stores.sparkSession
    widen = spark.createDataFrame([(a, b) for a, bs in WIDENING.items() for b in a + bs], "given_name string, elem_name string")
    nulls = stores.join(null_const, ["m", "v"], "left_semi").select("iid")
    prims = stores.join(F.broadcast(widen), ["given_name", "elem_name"], "left_semi").select("iid")
    refs = stores.join(subtype.select(F.col("sup").alias("elem"), F.col("sub").alias("given")), ["elem", "given"], "left_semi").select("iid")
    return union_all([nulls, prims, refs]).distinct()


def throws_anything(exc_edge: DataFrame) -> DataFrame:
    """(m, src, n_types, types): what each block may throw."""
    return exc_edge.groupBy("m", "src").agg(F.countDistinct("type").alias("n_types"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))


# --- strings ---------------------------------------------------------------------------------------------------


def string_values(const: DataFrame, copy: DataFrame, append: DataFrame) -> DataFrame:
    """(v, vals, is_any): possible strings of variables.

    ``const`` is (v, val, is_any), ``copy`` (dst, src; several rows merge), ``append`` (after, before, arg). Variables
    that nothing defines are any string, and so is what is built from them. Sets of ten strings or more are any string, so
    a variable rises a bounded number of times, and only what reads a changed one is looked at again.
    """
    copy, append = settle(copy.select("dst", "src").distinct()), settle(append.select("after", "before", "arg").distinct())
    read = copy.select(F.col("src").alias("v")).union(append.select("before")).union(append.select("arg")).distinct()
    made = union_all([const.select("v"), copy.select(F.col("dst").alias("v")), append.select(F.col("after").alias("v"))]).distinct()
    lost = read.join(made, "v", "left_anti").select("v", F.lit(None).cast("string").alias("val"), F.lit(True).alias("is_any"))
    base = const.select("v", "val", "is_any").unionByName(lost)
    none = F.array().cast("array<string>")
    value = lambda vals, wide: F.struct(vals.alias("vals"), wide.alias("is_any"))
    seed = base.select("v", value(F.when(F.col("is_any") | F.col("val").isNull(), none).otherwise(F.array("val")), F.col("is_any")).alias("x"))

    def appended(before: DataFrame, arg: DataFrame) -> DataFrame:
        both = append.join(before.select(F.col("v").alias("before"), F.col("x").alias("a")), "before").join(arg.select(F.col("v").alias("arg"), F.col("x").alias("b")), "arg")
        return both.select(F.col("after").alias("v"), value(*L.append_strings(F.col("a.vals"), F.col("a.is_any"), F.col("b.vals"), F.col("b.is_any"))).alias("x"))

    def step(changed: DataFrame, state: DataFrame) -> DataFrame:
        copied = copy.join(changed, copy["src"] == changed["v"]).select(F.col("dst").alias("v"), "x")
        return union_all([copied, appended(changed, state), appended(state, changed)])

    found = rise(seed, ["v"], {"x": lambda c: value(*L.join_strings(f"{c}.vals", f"{c}.is_any"))}, step)
    return found.select("v", "x.vals", "x.is_any")


# --- aggregate reports -----------------------------------------------------------------------------------------


def collect(checks: DataFrame, kind: str) -> DataFrame:
    """(counter, bad, possible, ratio): instructions (iid, ctx, bad) count once, and as bad if any context is bad."""
    each = checks.groupBy("iid").agg(F.bool_or("bad").alias("bad"))
    bad, n = F.coalesce(F.count_if("bad"), F.lit(0)), F.count(F.lit(1))
    return each.agg(bad.alias("bad"), n.alias("possible")).select(F.lit(kind).alias("counter"), "bad", "possible", F.when(F.col("possible") > 0, F.col("bad") / F.col("possible")).otherwise(F.lit(float("nan"))).alias("ratio"))


def collect_all(null_checks: DataFrame, casts: DataFrame, divisors: DataFrame, defs: DataFrame, indices: DataFrame) -> DataFrame:
    """The five ratios; the last is given both ways: indices that may be negative, and those that cannot."""
    zero = lambda d: d.select("iid", "ctx", L.has_zero(F.col("value")).alias("bad"))
    negative = indices.select("iid", "ctx", (~L.non_negative(F.col("value"))).alias("bad"))
    return union_all([collect(null_checks, "npe"), collect(casts, "cast"), collect(zero(divisors), "arithmetic"), collect(zero(defs), "zero_interval"), collect(negative, "negative_index"), collect(negative.withColumn("bad", ~F.col("bad")), "non_negative_index")])
