"""Whole-program analyses against an interpreter in plain Python, on a small program with loops, calls and recursion."""

import math

import pytest
from pyspark.sql import functions as F

from lattica.functions import lattices as L
from lattica.operators import analyses as A
from lattica.operators import interprocedural as I
from lattica.operators import value_analyses as V
from lattica.operators import var_maps as M
from lattica.plans import programs as P

INF = math.inf
TOP = (-INF, INF, True)


def iv(lo, hi, nan=False):
    return (-INF if abs(lo) > 10 else float(lo), INF if abs(hi) > 10 else float(hi), nan)


def joined(kind, values):
    values = [v for v in values if v is not None]
    if not values:
        return None
    return all(values) if kind == "nonnull" else iv(min(v[0] for v in values), max(v[1] for v in values), any(v[2] for v in values))


def arithmetic(op, a, b):
    if a is None or b is None:
        return None
    if op == "ADD":
        x = (a[0] + b[0], a[1] + b[1])
    elif op == "SUB":
        x = (a[0] - b[1], a[1] - b[0])
    else:
        x = [p * q for p in a[:2] for q in b[:2]]
    return TOP if any(math.isnan(v) for v in x) else iv(min(x), max(x), a[2] or b[2])


def refined(op, taken, v, n):
    if n is None:
        return v
    if (op == "EQ") == taken and op in ("EQ", "NE"):
        return iv(n, n)
    if op in ("EQ", "NE"):
        return v
    if (op in ("GE", "GT")) == taken:
        return iv(max(v[0], n), v[1], v[2]) if v[1] >= n else None
    return iv(v[0], min(v[1], n), v[2]) if v[0] <= n else None


class Interpreter:
    """Rounds over changed blocks, as the rules say; facts[m, bb][slot]."""

    def __init__(self, p, kind):
        rows = {k: [r.asDict() for r in d.collect()] for k, d in p.items()}
        self.kind, self.nn, self.rows = kind, kind == "nonnull", rows
        self.block = {}
        for r in sorted(rows["instr"], key=lambda r: r["idx"]):
            self.block.setdefault((r["m"], r["bb"]), []).append(r)
        self.exit = {r["m"]: r["bb"] for r in rows["exit"]}
        self.ways = {}
        for e in rows["edges"]:
            to = (I.NORMAL_EXIT if e["kind"] == "N" else I.EXCEPTIONAL_EXIT) if e["dst"] == self.exit[e["m"]] else e["dst"]
            self.ways.setdefault((e["m"], e["src"]), set()).add((to, e["kind"], e["branch"]))
        self.lit = {(r["m"], r["v"]): (r["kind"] != "null" if self.nn else iv(r["dval"], r["dval"])) for r in rows["const"] if self.nn or r["kind"] == "num"}
        self.call = {(r["m"], r["bb"]): r for r in rows["call"]}
        self.callees = {}
        for r in rows["call_edge"]:
            self.callees.setdefault(r["site"], []).append(r["callee"])
        self.actual = {(r["site"], r["i"]): r["v"] for r in rows["actual"]}
        self.native = {r["m"]: r["prim"] for r in rows["native"]}
        self.locs, self.fields = {}, {}
        for name, to in (("locs", self.locs), ("fields", self.fields)):
            for r in rows[name]:
                to.setdefault(r["iid"], []).append(-1000 - r["loc"])
        self.access = {}
        for r in rows["touch"]:
            self.access.setdefault(r["m"], set()).add(-1000 - r["loc"])
        calls = {(r["m"], c) for r in rows["call_edge"] for c in [r["callee"]]}
        for _ in range(20):
            for a, b in calls:
                self.access.setdefault(a, set()).update(self.access.get(b, ()))

    def run_block(self, m, bb, env):
        """{on: facts behind the block}, and (iid, before, after) of its instructions."""
        told, seen, env = {}, [], dict(env)
        get = lambda v: told.get(v, self.lit.get((m, v), env.get(v)))
        lines = self.block.get((m, bb), [])
        out = {}
        for k, r in enumerate(lines):
            op, u, before = r["op"], r["uses"], dict(env)
            static = op == "INVOKE_STATIC"
            new, failed = {}, {}
            if self.nn:
                if op in A.DEREFERENCES and not static:
                    new[u[0]] = True
                    failed[u[0]] = False
                if op in A.NEVER_NULL:
                    new[r["def"]] = True
                if op == "GET_FIELD":
                    new[r["def"]] = bool(r["prim"])
                if op == "CHECK_CAST":
                    failed[u[0]] = True
                if op in V.RAISING:
                    failed[M.EXCEPTION] = True
                fixed = dict(new)
                if op in ("PHI", "CHECK_CAST"):
                    x = joined("nonnull", [get(v) for v in (u if op == "PHI" else u[:1])])
                    if x is not None:
                        new[r["def"]] = x
                if op == "RETURN":
                    x = True if r["prim"] else get(u[0])
                    if x is not None:
                        new[M.RETURN] = x
            else:
                if op == "ARRAY_LENGTH":
                    new[r["def"]] = (0.0, INF, False)
                if op == "GET_FIELD" and r["prim"] and r["iid"] not in self.locs:
                    new[r["def"]] = TOP
                if op == "NEW_OBJECT":
                    new.update({x: iv(0, 0) for x in self.fields.get(r["iid"], [])})
                fixed, value = dict(new), None
                if op == "PHI" and r["prim"]:
                    value = joined(self.kind, [get(v) for v in u])
                elif op == "BINARY_OP":
                    value = arithmetic(r["bop"], get(u[0]), get(u[1]))
                elif op == "UNARY_NEG_OP":
                    a = get(u[0])
                    value = None if a is None else iv(-a[1], -a[0], a[2])
                elif op == "GET_FIELD" and r["prim"] and r["iid"] in self.locs:
                    value = joined(self.kind, [env.get(x) for x in self.locs[r["iid"]]])
                if value is not None:
                    new[r["def"]] = value
                if op == "RETURN" and r["prim"] and get(u[0]) is not None:
                    new[M.RETURN] = get(u[0])
                if op == "PUT_FIELD" and get(u[1]) is not None:
                    new.update({x: joined(self.kind, [env.get(x), get(u[1])]) for x in self.locs.get(r["iid"], [])})
            told.update(fixed)
            env.update(new)
            if k == len(lines) - 1:
                out = {"N": env, "E": {**before, **failed}}
                if not self.nn and op == "CONDITIONAL_BRANCH" and get(u[0]) is not None:
                    n = get(u[1])
                    for side in "TF":
                        x = refined(r["operator"], side == "T", get(u[0]), n[0] if n and n[0] == n[1] else None)
                        out[side] = {s: w for s, w in {**env, u[0]: x}.items() if w is not None}
            seen.append((r["iid"], before, dict(env)))
        return out, seen

    def returned(self, m, bb, facts):
        """{kind: updates} of a call's callees; None if it has none."""
        c = self.call.get((m, bb))
        if c is None or not self.callees.get(c["site"]):
            return None
        got = {}
        for callee in self.callees[c["site"]]:
            for at, kind in ((I.NORMAL_EXIT, "N"), (I.EXCEPTIONAL_EXIT, "E")):
                if (callee, at) in facts:
                    to = got.setdefault(kind, {})
                    for s, v in facts[callee, at].items():
                        slots = [c["result"] if s == M.RETURN else c["exc"] if s == M.EXCEPTION else s if s == M.REACHED or s <= -1000 else None]
                        if self.nn and s in P.FORMALS[1:]:
                            slots.append(self.actual.get((c["site"], P.FORMALS.index(s))))
                        for slot in slots:
                            if slot is not None:
                                to.setdefault(slot, []).append(v)
        return {k: {s: joined(self.kind, v) for s, v in to.items()} for k, to in got.items()}

    def missing(self, c):
        if self.nn:
            return {"N": {c["result"]: False}, "E": {c["exc"]: True}}
        return {"N": {} if c["prim"] else {c["result"]: TOP}, "E": {}}

    def solve(self):
        facts, one = {}, True if self.nn else iv(0, 0)
        for r in self.rows["roots"]:
            m = r["m"]
            facts[m, 0] = {M.REACHED: one, 1: True if self.nn else iv(m % 5, m % 5), 2: m % 2 == 0 if self.nn else iv(0, m % 5)}
        changed = set(facts)
        while changed:
            back = {(c["m"], c["bb"]) for c in self.call.values() for x in self.callees.get(c["site"], []) if (x, I.NORMAL_EXIT) in changed or (x, I.EXCEPTIONAL_EXIT) in changed}
            new = []
            for m, bb in {k for k in changed if k[1] >= 0} | {k for k in back if k in facts}:
                env = facts[m, bb]
                out, _ = self.run_block(m, bb, env)
                c, got = self.call.get((m, bb)), self.returned(m, bb, facts)
                for to, kind, branch in self.ways.get((m, bb), ()):
                    if c and got is not None and kind not in got and not (kind == "E" and (not self.nn or not c["is_static"])):
                        continue
                    env2 = dict(out.get(branch, out.get(kind, env)))
                    if c:
                        env2.update({s: v for s, v in (got if got is not None else self.missing(c)).get(kind, {}).items() if s != M.REACHED})
                    new.append(((m, to), env2))
                for callee in self.callees.get(c["site"], []) if c else []:
                    if callee in self.native:
                        prim = self.native[callee]
                        n = {M.REACHED: one, **({M.RETURN: False} if self.nn else {M.RETURN: TOP} if prim else {})}
                        new += [((callee, I.NORMAL_EXIT), n), ((callee, I.EXCEPTIONAL_EXIT), {M.REACHED: one, **({M.EXCEPTION: True} if self.nn else {})})]
                        continue
                    given = {M.REACHED: one, **({} if self.nn else {s: v for s, v in env.items() if s in self.access.get(callee, ())})}
                    for i, f in enumerate(P.FORMALS):
                        v = self.actual[c["site"], i]
                        x = True if self.nn and i == 0 and not c["is_static"] else self.lit.get((m, v), env.get(v))
                        if x is not None:
                            given[f] = x
                    new.append(((callee, 0), given))
            changed = set()
            for key, env in new:
                there = facts.setdefault(key, {})
                for s, v in env.items():
                    x = joined(self.kind, [there.get(s), v])
                    if x != there.get(s):
                        there[s] = x
                        changed.add(key)
        return facts

    def states(self, facts):
        out = set()
        for (m, bb), env in facts.items():
            if bb < 0:
                continue
            _, seen = self.run_block(m, bb, env)
            c, got = self.call.get((m, bb)), self.returned(m, bb, facts)
            for k, (iid, before, after) in enumerate(seen):
                if c and k == len(seen) - 1:
                    after = {**after, **(got if got is not None else self.missing(c)).get("N", {})}
                out |= {(iid, v, before.get(v), after.get(v)) for v in {*before, *after} if v >= 0}
        return out


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("program"))
    spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey < 70").write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey < 80").write.parquet(f"{folder}/orders.parquet")
    return P.program(spark, folder)


def plain(v):
    return tuple(v) if isinstance(v, tuple) else v


@pytest.mark.parametrize("kind", ["nonnull", "intervals"])
def test_solver_against_an_interpreter(small, kind):
    facts, events = P.solve_nonnull(small) if kind == "nonnull" else P.solve_intervals(small)
    brute = Interpreter(small, kind)
    want = brute.solve()
    got = {}
    for r in facts.collect():
        got.setdefault((r["m"], r["bb"]), {})[r["slot"]] = plain(r["value"])
    drop = lambda d: {k: {s: v for s, v in e.items() if s != M.REACHED or kind == "nonnull"} for k, e in d.items()}
    assert drop(got) == drop(want)
    shown = {(r["iid"], r["v"], plain(r["before"]), plain(r["after"])) for r in I.states(facts, small["instr"], events).collect()}
    assert shown == brute.states(want)
    assert any(c in brute.callees.get(x["site"], []) for x in brute.call.values() for c in [x["m"]])  # recursion is there


def test_map_algebra(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, slot long, value boolean")
    rows = lambda d: sorted(map(tuple, d.select("k", "slot", "value").collect()))
    a, b = make([(1, 0, True), (1, -1005, False), (1, M.RETURN, True), (2, 3, False)]), make([(1, 0, False), (1, 7, True), (2, 3, False)])
    key, fold = ["k"], L.join_must
    assert rows(M.join([a, b], key, fold)) == rows(M.join([b, a], key, fold)) == [(1, -1005, False), (1, -1, True), (1, 0, False), (1, 7, True), (2, 3, False)]
    assert rows(M.join([a, a], key, fold)) == rows(a)
    below = lambda x, y: x | ~y  # noqa: E731  true is the bottom
    at_most = lambda x, y: {r["k"]: r["leq"] for r in M.leq(x, y, key, below).collect()}
    assert at_most(a, M.join([a, b], key, fold)) == {1: True, 2: True}
    assert at_most(a, b) == {1: False, 2: True}
    assert rows(M.update(a, make([(1, 0, None), (1, 9, True), (2, 3, True)]), key)) == [(1, -1005, False), (1, -1, True), (1, 9, True), (2, 3, True)]
    assert rows(M.clear_locals(a)) == [(1, -1005, False)]
    assert rows(M.retain(a, spark.createDataFrame([(1, -1006)], "k long, slot long"), key)) == [(1, -1, True), (1, 0, True), (2, 3, False)]


def test_switch_joins_far_constants(spark):
    """y = phi(0, 42, 44) is any number, as bounds beyond ten lie at infinity."""
    assert tuple(spark.createDataFrame([(0.0,), (42.0,), (44.0,)], "d double").select(L.point(F.col("d")).alias("v")).agg(L.join_interval("v").alias("x")).first()["x"]) == (-INF, INF, False)
