"""The points-to solver on small programs worked out by hand, in several contexts, and its check of itself."""

import pytest

from lattica.functions import contexts as C
from lattica.operators import points_to as P
from lattica.operators import register as R

CONTEXTS = ("ContextInsensitive", "type(2,1)")


class Program:
    def __init__(self, spark, haf, entry=(0,), **tables):
        made = {k: spark.createDataFrame(v, P.STATEMENTS[k]) for k, v in tables.items()}
        self.found = P.solve(p := P.Program(made, spark.createDataFrame([(m,) for m in entry], "m long"), C.parse(haf)))
        self.program = p
        self._pts = {}
        for r in self.found["pts"].collect():
            self._pts.setdefault(r["v"], set()).add(r["heap"])

    def pts(self, v):
        return self._pts.get(v, set())

    def edges(self):
        return {(r["m"], r["callee"]) for r in self.found["call_edge"].collect()}

    def fields(self):
        return {(r["heap"], r["f"], r["heap2"]) for r in self.found["fpts"].collect()}


def call(m, site, kind, target, receiver=None, result=None, exc=None, selector=None):
    return (m, site, kind, target, selector, receiver, result, exc)


def alloc(*sites):
    """(site, type) pairs; every object is allocated by class 90."""
    return [(s, t, f"T{t}", 90, "Main") for s, t in sites]


# methods 0 main, 1 and on callees; values below; objects 101, 102, ...


@pytest.mark.parametrize("haf", CONTEXTS)
def test_a_field_written_by_a_constructor_is_read(spark, haf):
    """s = new A(); A() { this.f = new B(); } o1 = s.f."""
    p = Program(
        spark, haf, new=[(0, 1, 101), (1, 11, 102)], call=[call(0, 50, "special", 1, receiver=1)], actual=[(50, 0, 1)], formal=[(1, 0, 10)],
        store=[(1, 10, 7, 11)], load=[(0, 2, 1, 7)], alloc=alloc((101, 1), (102, 2)),
    )
    assert p.pts(1) == p.pts(10) == {101} and p.fields() == {(101, 7, 102)} and p.pts(2) == {102}


@pytest.mark.parametrize("haf", CONTEXTS)
def test_virtual_calls_dispatch_and_super_calls_do_not(spark, haf):
    """ss.foo(o1) runs Sub.foo, which calls super.foo(arg): stores arg, returns a new object."""
    p = Program(
        spark, haf, new=[(0, 1, 101), (0, 2, 102), (2, 21, 103)],
        call=[call(0, 50, "virtual", 2, receiver=1, result=3, selector="foo"), call(1, 51, "special", 2, receiver=10, result=12)],
        actual=[(50, 0, 1), (50, 1, 2), (51, 0, 10), (51, 1, 11)], formal=[(1, 0, 10), (1, 1, 11), (2, 0, 20), (2, 1, 22)], returns=[(1, 12), (2, 21)],
        store=[(2, 20, 7, 22)], dispatch=[(1, "foo", 1), (9, "foo", 2)], alloc=alloc((101, 1), (102, 2), (103, 3)),
    )
    assert p.edges() == {(0, 1), (1, 2)} and p.fields() == {(101, 7, 102)} and p.pts(3) == {103}


@pytest.mark.parametrize("haf", CONTEXTS)
def test_a_receiver_reaches_only_its_own_target(spark, haf):
    """x = phi(new C1, new C2); y = x.foo(), which returns this."""
    p = Program(
        spark, haf, new=[(0, 1, 101), (0, 2, 102)], assign=[(0, 3, 1, None), (0, 3, 2, None)], call=[call(0, 50, "virtual", None, receiver=3, result=4, selector="foo")],
        actual=[(50, 0, 3)], formal=[(1, 0, 10), (2, 0, 20)], returns=[(1, 10), (2, 20)], dispatch=[(1, "foo", 1), (2, "foo", 2)], alloc=alloc((101, 1), (102, 2)),
    )
    assert p.edges() == {(0, 1), (0, 2)} and p.pts(10) == {101} and p.pts(20) == {102} and p.pts(4) == {101, 102}


def test_thrown_objects_meet_handlers_by_type(spark):
    """A callee throws 101 (type 1) and 102 (type 2); the handler catches type 1 and hands it to foo; the rest leaves."""
    p = Program(
        spark, "ContextInsensitive", new=[(1, 11, 101), (1, 12, 102)], throws=[(1, 13)], assign=[(1, 13, 11, None), (1, 13, 12, None), (0, 5, 4, 1), (0, 6, 4, 2)],
        call=[call(0, 50, "static", 1, exc=4), call(0, 51, "static", 2)], actual=[(51, 0, 5)], formal=[(2, 0, 20)], filter_ok=[(1, 1), (2, 2)], alloc=alloc((101, 1), (102, 2)),
    )
    assert p.pts(4) == {101, 102} and p.pts(5) == p.pts(20) == {101} and p.pts(6) == {102}


def test_an_exception_caught_in_the_callee_does_not_reach_the_caller(spark):
    """getInstance catches its IOException (101) and throws a RuntimeException (102) instead: main sees the latter alone."""
    p = Program(
        spark, "ContextInsensitive", new=[(1, 11, 101), (1, 12, 102)], assign=[(1, 13, 11, 1), (1, 14, 11, 2), (1, 14, 12, None)], throws=[(1, 14)], call=[call(0, 50, "static", 1, exc=4)],
        filter_ok=[(1, 1), (2, 2)], alloc=alloc((101, 1), (102, 2)),
    )
    assert p.pts(13) == {101} and p.pts(4) == {102}


@pytest.mark.parametrize("haf", ("full(1)",))
def test_statics_arrays_initialisers_and_clones(spark, haf):
    """A static field written by a class initialiser; an array that holds type 2 only; a clone with its fields."""
    p = Program(
        spark, haf, new=[(0, 1, 101), (0, 2, 102), (0, 3, 103), (9, 91, 104)], class_init=[(0, 9)], sstore=[(9, 40, 91)], sload=[(0, 4, 40)], static_var=[(40, 400)],
        store=[(0, 1, P.CONTENTS, 2), (0, 1, P.CONTENTS, 3), (0, 2, 7, 3)], load=[(0, 5, 1, P.CONTENTS), (0, 8, 6, 7)], elem_ok=[(1, 2)],
        call=[call(0, 50, "virtual", None, receiver=2, result=6, selector="clone")], actual=[(50, 0, 2)], clone=[(50, 150)], alloc=alloc((101, 1), (102, 2), (103, 3), (104, 4), (150, 2)),
    )
    assert p.pts(4) == p.pts(400) == {104}
    assert p.pts(5) == {102} and p.pts(6) == {150} and p.pts(8) == {103}
    assert {(102, 7, 103), (150, 7, 103), (101, P.CONTENTS, 102)} == p.fields()
    assert set(P.paranoid(p.program, p.found).values()) == {0}


def test_contexts_part_what_one_context_joins(spark):
    """id(x) { return x; } called twice: call sites keep the results apart."""
    tables = dict(
        new=[(0, 1, 101), (0, 2, 102)], call=[call(0, 50, "static", 1, result=3), call(0, 51, "static", 1, result=4)], actual=[(50, 0, 1), (51, 0, 2)], formal=[(1, 0, 10)], returns=[(1, 10)],
        alloc=alloc((101, 1), (102, 2)),
    )
    assert Program(spark, "ContextInsensitive", **tables).pts(3) == {101, 102}
    apart = Program(spark, "cs(1)", **tables)
    assert apart.pts(3) == {101} and apart.pts(4) == {102} and apart.pts(10) == {101, 102}


def test_streams_and_named_methods_need_their_tables(spark):
    """A print stream's subclass counts as one through ``subtype``; without the tables the abstractions say so."""
    tables = dict(new=[(0, 1, 101), (0, 2, 102)], call=[call(0, 50, "special", 1, receiver=1), call(0, 51, "special", 1, receiver=2)], actual=[(50, 0, 1), (51, 0, 2)], formal=[(1, 0, 10)], alloc=alloc((101, 3), (102, 4)))
    names = [(2, C.PRINT_STREAM), (3, "Lapp/Log"), (4, "Lapp/A")]
    found = Program(spark, "CallSiteSensitiveOutputStream(1)", klass_name=names, subtype=[(2, 2), (2, 3), (3, 3), (4, 4)], **tables).found["reachable"].collect()
    assert {tuple(r["ctx"]) for r in found if r["m"] == 1} == {(50,), (C.NONE,)}
    for haf in ("CallSiteSensitiveOutputStream", "MagicCallSiteSensitive", "[scs(2) x MagicCallSiteSensitive(1)]"):
        with pytest.raises(ValueError):
            Program(spark, haf, **tables)


def test_an_open_fixpoint_is_noticed(spark):
    made = {"new": spark.createDataFrame([(0, 1, 101)], P.STATEMENTS["new"]), "assign": spark.createDataFrame([(0, 2, 1, None)], P.STATEMENTS["assign"]), "alloc": spark.createDataFrame(alloc((101, 1)), P.STATEMENTS["alloc"])}
    p = P.Program(made, spark.createDataFrame([(0,)], "m long"))
    found = P.solve(p)
    assert P.paranoid(p, found)["pts"] == 0
    assert P.paranoid(p, {**found, "pts": found["pts"].where("v = 1")})["pts"] == 1


def test_string_contexts_keep_the_whole_receiver(spark):
    """Receivers of one site whose contexts differ in the last element stay apart."""
    rows = spark.createDataFrame([([1, 2],), ([1, 3],)], "hctx array<long>")
    from pyspark.sql import functions as F

    row = {"hctx": F.col("hctx"), "heap": F.lit(5), "is_static": F.lit(False), "heap_class_name": F.lit("Ljava/lang/String")}
    assert sorted(r[0] for r in rows.select(C.StringObject(2).merge(row)).collect()) == [[5, 1, 2], [5, 1, 3]]


def test_equal_loads_and_phis_become_one(spark):
    """s1 = s0.foo, s2 = s0.foo: one load is left; phis of the same operands in any order are one."""
    stmts = [(0, "field", [1, 7], 11), (0, "field", [1, 7], 12), (0, "phi", [11, 20], 31), (0, "phi", [20, 12], 32)]
    kept, index = R.unduplicate(spark.createDataFrame(stmts, "m long, kind string, key array<long>, def long"))
    assert {r["def"] for r in kept.collect()} == {11, 31} and {(r["v"], r["rep"]) for r in index.collect()} == {(12, 11), (32, 31)}
