"""What only shows on larger tables: rows that lie elsewhere when they are read again, and tables small on disk alone."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lattica.operators import register as R


def test_duplicates_do_not_depend_on_where_rows_lie(spark):
    """the rows come in another order each time that they are read, as after a shuffle between machines."""
    n = 4000

    def shuffled(_):
        i = np.random.default_rng().permutation(n)
        yield pd.DataFrame({"m": i % 3, "kind": "field", "key": [[int(x) % 50, int(x) % 7] for x in i], "def": i + 1000})

    stmts = spark.range(0, 1, 1, 1).mapInPandas(shuffled, "m long, kind string, key array<long>, def long")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {(r["m"], *r["key"], r["def"]) for r in R.unduplicate(stmts)[0].collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    first = {}
    for x in range(n):
        first.setdefault((x % 3, x % 50, x % 7), x + 1000)
    assert got == {(*k, d) for k, d in first.items()}


def test_tables_are_judged_by_their_rows(spark):
    """a million rows that compress to less than the broadcast limit do not pass through the driver."""
    from lattica.operators.fixpoint import settle

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(1_000_000).select((F.col("id") / 1000).cast("long").alias("m"), F.lit(0).cast("long").alias("slot"), (F.col("id") % 50).alias("dom"))
        dom = settle(rows)
        other = settle(spark.range(2_000_000).select((F.col("id") / 2000).cast("long").alias("m"), F.col("id").alias("bb")))
        few = settle(spark.range(10).select(F.col("id").alias("m")))
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan(other.join(dom, "m"))
        assert "BroadcastHashJoin" in plan(other.join(few, "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_procedures_without_code_do_not_pass_through_the_driver(spark, sf):
    """NOT IN is planned as a broadcast of all lines, whatever their number."""
    from lattica.plans import throwing as T

    T._program(spark, sf)
    m = spark.table("lattica_line").select("m")
    sql = T._SQL["native"].replace("FROM orders", "FROM lattica_orders").replace("FROM line)", "FROM lattica_line)")
    got = T._native(spark, m)
    assert sorted(got.collect()) == sorted(spark.sql(sql).collect())
    assert T._native(spark, m.union(spark.sql("SELECT CAST(NULL AS BIGINT)"))).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = T._native(spark, spark.range(1000).select(F.col("id").alias("m")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan


def test_known_rows_are_not_compared_in_every_step(spark, monkeypatch):
    """a long chain, and a cycle behind it."""
    from lattica.operators import fixpoint as X

    calls = []
    old = X._first_steps
    monkeypatch.setattr(X, "_first_steps", lambda *a: calls.append(1) or old(*a))
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(30, 25)], "src long, dst long")
    seed = spark.createDataFrame([(0, 7), (28, 8)] + [(100 + i, 9) for i in range(200)], "node long, item long")
    got = {tuple(r) for r in X.closure(edges, seed).collect()}
    assert got == {(i, 7) for i in range(31)} | {(i, 8) for i in range(25, 31)} | {(100 + i, 9) for i in range(200)}
    assert len(calls) <= 5


def test_facts_move_in_long_hops_against_the_edges(spark, monkeypatch):
    """backward, the long paths lead to earlier blocks."""
    from lattica.functions import lattices as L
    from lattica.operators import dataflow as D
    from lattica.operators import fixpoint as X

    calls = []
    old = X.counted
    monkeypatch.setattr(X, "counted", lambda d: calls.append(1) or old(d))
    n = 48
    edges = spark.createDataFrame([(1, i, i + 1, "N") for i in range(n)] + [(1, i, i // 2, "N") for i in range(1, n, 5)], "m long, src long, dst long, kind string")
    got = D.solve_blocks(edges, spark.createDataFrame([(1, n, 3, True)], "m long, bb long, slot long, value boolean"), {"value": L.join_may}, backward=True)
    assert {r["bb"] for r in got.collect()} == set(range(n + 1))
    assert len(calls) < 40


def test_bits_are_set_after_values_are_brought_together(spark):
    """no bucket of four kilobytes is shuffled or sorted."""
    from lattica.operators import sets

    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sets.bitmaps(rows, "k", "x")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Exchange" in plan and "Exchange" not in plan[: plan.rindex("bitmap_construct_agg")]
    assert {(r["k"], r["n"]) for r in sets.bitmap_sizes(sets.bitmaps(rows, "k", "x"), "k").collect()} == {(k, len(range(k, 1000, 7))) for k in range(7)}


def test_few_pairs_of_sets_are_verified(spark, monkeypatch):
    """sets that share an element are not all compared element by element."""
    from lattica.operators import sets

    rng, sizes = np.random.default_rng(1), []
    every = {k: set(map(int, rng.integers(0, 60, 1 + k % 5))) for k in range(800)}
    old = sets.settle
    monkeypatch.setattr(sets, "settle", lambda d: (sizes.append((d.columns, old(d))), sizes[-1][1])[1])
    got = {tuple(r) for r in sets.contains_all(spark.createDataFrame([(k, x) for k, s in every.items() for x in s], "k long, x long")).collect()}
    want = {(a, b) for a, s in every.items() for b, t in every.items() if a != b and s <= t}
    assert got == want
    assert next(d.count() for c, d in sizes if c == ["a", "b", "n"]) < 1.2 * len(want)


def test_facts_are_carried_without_rounds(spark, monkeypatch):
    """A method of a thousand blocks costs no round, wherever Arrow's batches end."""
    from lattica.functions import lattices as L
    from lattica.operators import dataflow as D
    from lattica.operators import fixpoint as X

    rng = np.random.default_rng(3)
    edges = {(m, i, i + 1) for m in range(5) for i in range(40)} | {(m, int(a), int(b)) for m in range(5) for a, b in rng.integers(0, 60, (30, 2))} | {(9, i, i + 1) for i in range(1000)}
    seed = {(m, int(b), int(b) % 3, bool(b % 2)) for m in range(5) for b in rng.integers(0, 60, 4)} | {(9, 0, 0, True), (9, 1000, 1, False), (7, 5, 0, True), (None, 5, 0, True)}
    monkeypatch.setattr(X, "counted", lambda d: 1 / 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for backward in (False, True):
            got = D.solve_blocks(spark.createDataFrame([(*e, "N") for e in edges], "m long, src long, dst long, kind string"), spark.createDataFrame(list(seed), "m long, bb long, slot long, value boolean"), {"value": L.join_may}, backward=backward)
            want = {}
            for m, b, slot, value in seed:
                seen, todo = set(), [b]
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        todo += [s if backward else d for n, s, d in edges if n == m and (d if backward else s) == x]
                for x in seen:
                    want[m, x, slot] = want.get((m, x, slot), False) or value
            assert {(r["m"], r["bb"], r["slot"]): r["value"] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exceptions_are_routed_once(spark, monkeypatch):
    """up a chain of calls only what leaves is followed; a handler that is an exit lets its types leave."""
    from lattica.operators import exceptions as E

    calls = []
    old = E.routes
    monkeypatch.setattr(E, "routes", lambda *a: calls.append(1) or old(*a))
    n, df = 12, spark.createDataFrame
    rows = lambda d: {tuple(r) for r in d.collect()}
    edges = [(m, 1, 9, "E") for m in range(n)] + [(7, 1, 2, "E"), (4, 1, 9, "E")]
    t = E.Throwing(
        df([(n - 1, 1, "IOException"), (n - 1, 1, "NullPointerException"), (n - 1, 1, "Other")], "m long, bb long, type string"), df([(m, 1, m + 1, m == 9) for m in range(n - 1)] + [(3, 1, 6, False)], "m long, bb long, callee long, safe boolean"),
        df(edges, "m long, src long, dst long, kind string"), df([(7, 2, "IOException"), (4, 9, "Other")], "m long, bb long, type string"), df([("IOException", "IOException"), ("Other", "Other")], "sup string, sub string"),
        df([(m, 9) for m in range(n)], "m long, bb long"), df([(m, 1) for m in range(n)], "m long, bb long"), df([(8, "Declared")], "m long, type string"),
    )
    edge, leaves = E.flow(t)
    want = {(m, "Other") for m in range(n)} | {(m, "Declared") for m in range(9)} | {(m, "IOException") for m in range(8, n)} | {(m, "NullPointerException") for m in (10, 11)}
    assert rows(leaves) == want
    callee = {m: [m + 1] + [6] * (m == 3) for m in range(n - 1)}
    thrown = {(m, x) for m, cs in callee.items() for c in cs for k, x in want if k == c and not (m == 9 and x == "NullPointerException")} | {(n - 1, x) for x in ("IOException", "NullPointerException", "Other")}
    assert rows(edge) == {(m, 1, x, 2 if (m, x) == (7, "IOException") else 9) for m, x in thrown}
    assert len(calls) <= 2
    # a dead edge is not taken: nothing comes out of 5
    dead = rows(E.flow(t, df([(5, 1, 9)], "m long, src long, dst long"))[1])
    assert 5 not in {m for m, _ in dead} and 4 not in {m for m, _ in dead} and (3, "Other") in dead


def test_static_calls_are_settled_before_sets(spark, monkeypatch):
    """the call graph asks for no set; the sets are those of the one loop over all relations."""
    from lattica.operators import fixpoint as X
    from lattica.operators import points_to as P

    written = []
    old = X.counted
    monkeypatch.setattr(X, "counted", lambda d: written.append(d.columns) or old(d))
    n, df = 3, spark.createDataFrame

    def program(more=()):
        call = [(m, 100 + m, "static", m + 1, None, None, 10 * m + 5, None) for m in range(n)] + [(n, 199, "static", 2, None, None, None, None), *more]
        rows = {
            "new": [(m, 10 * m, m) for m in range(n + 2)], "assign": [(m, 10 * m, 10 * m + 1, None) for m in range(n + 1)] + [(1, 18, 10, 7)], "store": [(m, 10 * m, 1, 10 * m + 1) for m in range(n)], "load": [(m, 10 * m + 4, 10 * m, 1) for m in range(n)],
            "call": call, "actual": [(100 + m, 0, 10 * m) for m in range(n)] + [(199, 0, 10 * n + 4)], "formal": [(m, 0, 10 * m + 1) for m in range(n + 1)], "returns": [(m, 10 * m + 4) for m in range(n + 1)], "alloc": [(m, m % 3, "T", m, "A") for m in range(n + 2)],
            "filter_ok": [(7, 0), (7, 1)], "sstore": [(2, 77, 20)], "sload": [(1, 58, 77)], "static_var": [(77, 7700)], "class_init": [(1, n + 1)],
        }
        return P.Program({k: df(v, P.STATEMENTS[k]) for k, v in rows.items()}, df([(0,)], "m long"))

    found = P.solve(program())
    assert {r["m"] for r in found["reachable"].collect()} == set(range(n + 2))
    assert found["call_edge"].count() == n + 1
    assert not any("hctx" in c for c in written)
    whole = P.solve(program([(0, 999, "virtual", 1, "s", 12345, None, None)]))  # a receiver that is no object
    assert isinstance(whole, dict) and set(whole) == set(found)
    for name in found:
        assert sorted(map(str, found[name].collect())) == sorted(map(str, whole[name].collect())), name
    assert found["fpts"].count() > 0
