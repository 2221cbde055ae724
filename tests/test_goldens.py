"""Small programs and values whose results are known."""

import math

import pytest
from pyspark.sql import functions as F

from lattica.functions import contexts as C
from lattica.functions import lattices as L
from lattica.functions import text as T
from lattica.operators import analyses as A
from lattica.operators import fixpoint, pdg, sets
from lattica.operators import points_to as P

INF = math.inf


@pytest.mark.parametrize(
    ("text", "shown"),
    [("type", "2Type+1H"), ("scs", "scs(2)"), ("cs", "cs(2)"), ("full", "2FullObjSens+1H"), ("type(3,4)", "3Type+4H"), ("scs(55)", "scs(55)"), ("cs(34)", "cs(34)"), ("full(99)", "99FullObjSens+1H"), ("TypeSensitive(20,10)", "20Type+10H"), ("[scs(2) x type(2,1)]", "scs(2) x 2Type+1H"), ("CollectionsTypeSensitive", "Collections-2Type+1H"), ("OneObjSensitive", "OneObjSens"), ("StringBuilderFullObjSensitive", "2StringBuilderFullObjSens+1H"), ("InstanceInitFullObjSensitive", "1InitFullObjSens+1H")],
)
def test_abstraction_expressions(text, shown):
    assert str(C.parse(text)) == shown


@pytest.mark.parametrize("text", ["", "nonsense", "type(2", "scs x", "[type"])
def test_broken_abstraction_expressions(text):
    with pytest.raises(C.HafSyntaxError):
        C.parse(text)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_context_stacks(spark):
    a = C.push(C.empty(), F.lit(7), 2)
    b = C.push(a, F.lit(8), 2)
    c = C.push(b, F.lit(9), 2)
    assert value(spark, a) == [7, C.NONE]
    assert value(spark, c) == [9, 8]
    assert value(spark, C.push(a, F.lit(1), 0)) == []
    assert value(spark, C.truncate(c, 1)) == [9]


def iv(spark, lo, hi):
    return L.interval(F.lit(float(lo)), F.lit(float(hi)))


def bounds(spark, column):
    x = value(spark, column)
    return None if x is None else (x["lo"], x["hi"])


def test_intervals(spark):
    assert bounds(spark, L.point(F.lit(5.0))) == (5, 5)
    assert bounds(spark, L.point(F.lit(42.0))) == (-INF, INF)
    assert bounds(spark, iv(spark, -3, 11)) == (-3, INF)
    op = lambda name, a, b: bounds(spark, L.arithmetic(F.lit(name), iv(spark, *a), iv(spark, *b)))
    assert op("DIV", (1, 4), (0, 2)) == (-INF, INF)
    assert op("DIV", (2, 4), (1, 2)) == (1, 4)
    assert op("REM", (1, 4), (3, 5)) == (0, 5)
    assert op("MUL", (-2, 3), (4, 5)) == (-10, INF)
    assert bounds(spark, L.at_most(iv(spark, 5, 8), F.lit(3.0))) is None
    assert bounds(spark, L.at_least(F.lit(None).cast("struct<lo:double,hi:double,nan:boolean>"), F.lit(3.0))) == (3, INF)
    joined = spark.range(2).select(F.when(F.col("id") == 0, iv(spark, 1, 2)).otherwise(iv(spark, 4, 5)).alias("v")).agg(L.join_interval("v").alias("x")).first()["x"]
    assert (joined["lo"], joined["hi"]) == (1, 5)


def test_booleans(spark):
    both = spark.createDataFrame([(L.TRUE,), (L.FALSE,)], "v int").agg(L.join_bool("v").alias("x")).first()["x"]
    assert both == L.UNKNOWN
    assert value(spark, L.bool_op("and", F.lit(L.FALSE), F.lit(L.UNKNOWN))) == L.UNKNOWN


def strings(spark, const, copy=(), append=()):
    found = A.string_values(spark.createDataFrame(const, "v string, val string, is_any boolean"), spark.createDataFrame(list(copy), "dst string, src string"), spark.createDataFrame(list(append), "after string, before string, arg string"))
    return {r["v"]: "ANY" if r["is_any"] else set(r["vals"]) for r in found.collect()}


def test_string_builder_appends(spark):
    const = [("c1", "foo", False), ("c2", "bar", False), ("c3", "baz", False)]
    copy = [("sb0", "c1"), ("sb3", "sb1"), ("sb3", "sb2"), ("arg", "sb3"), ("lost", "nowhere")]
    found = strings(spark, const, copy, [("sb1", "sb0", "c2"), ("sb2", "sb0", "c3")])
    assert found["arg"] == {"foobar", "foobaz"}
    assert found["lost"] == "ANY"


def test_ten_strings_are_any_string(spark):
    assert strings(spark, [("v", str(i), False) for i in range(9)])["v"] == {str(i) for i in range(9)}
    assert strings(spark, [("v", str(i), False) for i in range(10)])["v"] == "ANY"


def test_phi_hands_both_objects_to_a_static_callee(spark):
    make = lambda name, rows: spark.createDataFrame(rows, P.STATEMENTS[name])
    tables = {
        "new": make("new", [(0, 1, 101), (0, 2, 102)]),
        "assign": make("assign", [(0, 3, 1, None), (0, 3, 2, None)]),
        "call": make("call", [(0, 50, "static", 1, None, None, None, None)]),
        "actual": make("actual", [(50, 0, 3)]),
        "formal": make("formal", [(1, 0, 10)]),
        "alloc": make("alloc", [(101, 1, "A", 0, "M"), (102, 1, "A", 0, "M")]),
    }
    found = P.solve(P.Program(tables, spark.createDataFrame([(0,)], "m long")))
    pts = {(r["v"], r["heap"]) for r in found["pts"].collect()}
    assert {h for v, h in pts if v == 3} == {101, 102}
    assert {h for v, h in pts if v == 10} == {101, 102}
    assert {(r["m"], r["callee"]) for r in found["call_edge"].collect()} == {(0, 1)}


def test_round_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    with pytest.raises(fixpoint.RoundLimit):
        fixpoint.closure(edges, spark.createDataFrame([(0, 0)], "node long, item long"), most_rounds=2)


def test_names(spark):
    assert value(spark, T.type_name(F.lit("[[Ljava/lang/String"))) == "String[][]"
    assert value(spark, T.type_name(F.lit("I"))) == "int"
    assert value(spark, T.operator_symbol(F.lit("REM"))) == "%"
    assert value(spark, T.dot_escape(F.lit('a"b\nc'))) == 'a\\"b\\nc'


def test_sets_and_queues(spark):
    rows = spark.createDataFrame([(1, 5), (1, 40_000), (2, 5), (1, 5)], "k long, x long")
    maps = sets.bitmaps(rows, "k", "x")
    assert {r["k"]: r["n"] for r in sets.bitmap_sizes(maps, "k").collect()} == {1: 2, 2: 1}
    assert [(r["a"], r["b"]) for r in sets.contains_all(rows).collect()] == [(2, 1)]
    seen = sets.work_queue(spark.createDataFrame([(1,)], "x long"), lambda d: d.select(((F.col("x") * 2) % 11).alias("x")))
    assert seen.count() == 10


def test_restored_counter_of_a_diamond(spark):
    edges = [(0, 1), (0, 2), (1, 3), (2, 3)]
    dom = [(0, b, d) for b, ds in {0: [0], 1: [0, 1], 2: [0, 2], 3: [0, 3]}.items() for d in ds]
    post = [(0, b, d) for b, ds in {0: [0, 3], 1: [1, 3], 2: [2, 3], 3: [3]}.items() for d in ds]
    frame = lambda rows: spark.createDataFrame(rows, "m long, bb long, dom long")
    found = pdg.restore_pc(frame(dom), frame(post), spark.createDataFrame([(0, 3)], "m long, bb long")).collect()
    assert len(edges) == 4 and [(r["bb"], r["at"]) for r in found] == [(3, 0)]


def test_all_handlers_that_catch_are_successors(spark):
    """Two sure handlers both stay; a handler of a subtype only for calls; without a sure one the exit too."""
    from lattica.operators import dataflow

    sub = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3), (1, 3)], "sup long, sub long")
    edges = spark.createDataFrame([(0, s, d, "E") for s in (0, 1, 2) for d in (10, 11, 12)], "m long, src long, dst long, kind string")
    catches = spark.createDataFrame([(0, 10, 0, 1), (0, 11, 0, 2), (0, 12, 0, 3)], "m long, bb long, ord int, type long")
    thrown = spark.createDataFrame([(0, 0, 2, False), (0, 1, 1, True), (0, 2, 4, True)], "m long, bb long, type long, is_call boolean")
    exits = spark.createDataFrame([(0, 99)], "m long, bb long")
    got = {(r["bb"], r["dst"]) for r in dataflow.exception_successors(thrown, edges, catches, sub, exits).collect()}
    assert got == {(0, 10), (0, 11), (1, 10), (1, 11), (1, 12), (2, 99)}
