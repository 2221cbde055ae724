"""Flow-sensitive analysis over control-flow graphs: facts in rows, lattices as aggregates.

A fact is a row (m, bb, slot, value columns). A solver round moves the facts that changed through their block's transfer,
along the out-edges, and joins them at the targets; blocks that did not change are not looked at again.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.fixpoint import follow, grow, rise, settle, union_all


def solve_blocks(edges: DataFrame, seed: DataFrame, join: dict[str, Callable[[str], Column]], transfer: Callable[[DataFrame], DataFrame] | None = None, backward: bool = False, widen: Callable[[DataFrame], DataFrame] = lambda d: d, most_rounds: int | None = None) -> DataFrame:
    """Facts that hold on entry to each block: (m, bb, slot, *join).

    Without a ``transfer`` facts reach blocks as they are: they are carried method by method, without rounds, and joined
    where they meet. With one, a round passes every block that changed and the rounds grow with the longest path.
    ``edges`` is (m, src, dst, kind); ``seed`` holds facts at entries. ``transfer`` maps rows of a block's entry facts to
    exit facts; if it adds a column ``on`` they follow only edges of that kind. ``backward`` runs against the edges.
    """
    e = edges.select("m", F.col("dst" if backward else "src").alias("bb"), F.col("src" if backward else "dst").alias("to"), "kind")
    if transfer is None:
        at = carried(e.select("m", "bb", "to"), seed.select("m", "bb", "slot", *join), backward)
        return widen(at.groupBy("m", "bb", "slot").agg(*[f(c).alias(c) for c, f in join.items()]))

    e = e.distinct()

    def step(changed: DataFrame, state: DataFrame) -> DataFrame:
        out = transfer(changed)
        moved = out.join(e, ["m", "bb"])
        if "on" in out.columns:
            moved = moved.where("on is null or on = kind")
        return moved.select("m", F.col("to").alias("bb"), "slot", *join)

    return rise(seed, ["m", "bb", "slot"], join, step, widen, most_rounds)


def carried(edges: DataFrame, seed: DataFrame, backward: bool = False) -> DataFrame:
    """``seed`` (m, bb, ...) with a row for each block that its rows' blocks lead to along ``edges`` (m, bb, to).

    A method is one group of a task, as in ``dominators``. Rows without a method or block lead nowhere.
    """
    more = [c for c in seed.columns if c not in ("m", "bb")]
    here = seed.select(F.col("m").cast("long").alias("m"), F.col("bb").cast("long").alias("bb"), *more)
    rows = here.select("m", "bb", F.lit(None).cast("long").alias("to"), *more).where("m is not null and bb is not null")
    ways = edges.where("m is not null and bb is not null and to is not null").select(F.col("m").cast("long").alias("m"), F.col("bb").cast("long").alias("bb"), F.col("to").cast("long").alias("to"))
    both = rows.unionByName(ways, allowMissingColumns=True).repartition("m").sortWithinPartitions("m")
    lost = here.where("m is null or bb is null").distinct()
    return both.mapInArrow(_carrier(more, backward), here.schema).unionByName(lost)


def _carrier(more: list[str], backward: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of a task. Its functions are made here so that they travel whole: workers need not find this package."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by ascending m: whole methods at once, the last one is held until it is complete."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column("m").to_numpy()
            if m[0] == m[-1] and held and held[-1].column("m")[0].as_py() == m[0]:
                held.append(b)
                continue
            last = int(np.searchsorted(m, m[-1]))
            if last or held:
                yield from spread(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = [b.slice(last)]
        if held:
            yield from spread(pa.Table.from_batches(held))

    def spread(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m = t["m"].to_numpy()
        starts = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
        src, to = t["bb"].to_pylist(), t["to"].to_pylist()
        words = list(zip(*[t[c].to_pylist() for c in more])) if more else [()] * len(m)
        at, block = [], []
        for a, end in zip(starts, starts[1:]):
            next_: dict[int, list[int]] = {}
            mask: dict[int, int] = {}
            bits: dict[str, int] = {}
            rows: list[int] = []  # a row of the seed for each bit
            for i in range(a, end):
                if to[i] is not None:
                    next_.setdefault(src[i], []).append(to[i])
                    continue
                word = repr(words[i])
                if word not in bits:
                    bits[word] = 1 << len(rows)
                    rows.append(i)
                mask[src[i]] = mask.get(src[i], 0) | bits[word]
            # blocks that changed, the nearest to the start first: most paths lead on in that direction
            sign = -1 if backward else 1
            todo = [sign * b for b in mask]
            heapq.heapify(todo)
            waiting = set(todo)
            while todo:
                key = heapq.heappop(todo)
                waiting.discard(key)
                has = mask[sign * key]
                for d in next_.get(sign * key, ()):
                    old = mask.get(d, 0)
                    if has & ~old:
                        mask[d] = old | has
                        if sign * d not in waiting:
                            waiting.add(sign * d)
                            heapq.heappush(todo, sign * d)
            told: dict[int, list[int]] = {}
            for b, has in mask.items():
                if has not in told:
                    told[has] = [r for k, r in enumerate(rows) if has >> k & 1]
                at += told[has]
                block += [b] * len(told[has])
                if len(at) >= 1 << 16:
                    yield from taken(t, at, block)
                    at, block = [], []
        yield from taken(t, at, block)

    def taken(t: pa.Table, at: list[int], block: list[int]) -> Iterator[pa.RecordBatch]:
        if at:
            found = t.select(["m", *more]).take(pa.array(at, pa.int64()))
            yield from found.add_column(1, "bb", pa.array(block, pa.int64())).combine_chunks().to_batches()

    return carry


def reachable_blocks(edges: DataFrame, entries: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """(m, bb) reached from ``entries`` (m, bb) along ``edges`` without the ``dead`` ones (m, src, dst)."""
    live = edges.select("m", "src", "dst")
    if dead is not None:
        live = live.join(dead.select("m", "src", "dst"), ["m", "src", "dst"], "left_anti")
    return carried(live.select("m", F.col("src").alias("bb"), F.col("dst").alias("to")), entries.select("m", "bb"))


def exception_successors(thrown: DataFrame, edges: DataFrame, catch_type: DataFrame, subtype: DataFrame, exits: DataFrame) -> DataFrame:
    """(m, bb, type, dst): where an exception of a type thrown in a block may go.

    ``thrown`` is (m, bb, type, is_call). Every handler of a supertype catches; a handler of a subtype may catch what a
    call throws. Types that no handler surely catches also go to the exit of ``exits`` (m, bb).
    """
    return routes(thrown, handlers(edges, catch_type), subtype, exits)


def handlers(edges: DataFrame, catch_type: DataFrame) -> DataFrame:
    """(m, bb, dst, caught): handlers that exceptional edges lead to, and a type that each catches."""
    succ = edges.where("kind = 'E'").select("m", F.col("src").alias("bb"), "dst")
    return succ.join(catch_type.select("m", F.col("bb").alias("dst"), F.col("type").alias("caught")), ["m", "dst"]).select("m", "bb", "dst", "caught")


def routes(thrown: DataFrame, handler: DataFrame, subtype: DataFrame, exits: DataFrame) -> DataFrame:
    """``exception_successors`` over ``handlers``: a row thrown meets its handlers and its method's exits once each."""
    above = subtype.select(F.col("sup").alias("caught"), F.col("sub").alias("type"), F.lit(True).alias("sure"))
    below = subtype.select(F.col("sub").alias("caught"), F.col("sup").alias("type"), F.lit(True).alias("maybe"))
    h = thrown.join(handler, ["m", "bb"], "left").join(above, ["caught", "type"], "left").join(below, ["caught", "type"], "left")
    takes = F.col("sure") | (F.col("maybe") & F.col("is_call"))
    found = h.groupBy("m", "bb", "type").agg(F.collect_set(F.when(takes, F.col("dst"))).alias("to"), F.coalesce(F.bool_or("sure"), F.lit(False)).alias("caught"))
    outs = exits.groupBy("m").agg(F.collect_set("bb").alias("outs"))
    left = F.when(F.col("caught") | F.col("outs").isNull(), F.col("to")).otherwise(F.array_union("to", "outs"))
    return found.join(outs, "m", "left").select("m", "bb", "type", F.explode(left).alias("dst"))


def branch_successors(branches: DataFrame, edges: DataFrame) -> DataFrame:
    """(m, bb, dst, taken): a branch's false successor is the next block, its true successor any other."""
    e = edges.where("kind = 'N'").select("m", F.col("src").alias("bb"), "dst")
    return branches.join(e, ["m", "bb"]).select("m", "bb", "dst", (F.col("dst") != F.col("bb") + 1).alias("taken"))


def exit_facts(facts: DataFrame, edges: DataFrame, exits: DataFrame, join: dict[str, Callable[[str], Column]]) -> DataFrame:
    """(m, kind, slot, *join): facts at a procedure's normal and exceptional exits; no row, no such exit."""
    e = edges.join(exits.select("m", F.col("bb").alias("dst")), ["m", "dst"]).select("m", F.col("src").alias("bb"), "kind")
    return facts.join(e, ["m", "bb"]).groupBy("m", "kind", "slot").agg(*[f(c).alias(c) for c, f in join.items()])


def last_instruction(instr: DataFrame) -> DataFrame:
    return instr.groupBy("m", "bb").agg(F.max_by("iid", "idx").alias("iid"))


def locations(pts: DataFrame, access: DataFrame, resolve: DataFrame, heap_type: DataFrame) -> DataFrame:
    """(iid, loc): locations that field accesses (iid, base, name) may mean, by the receivers' types; name null: elements."""
    hit = access.join(pts.withColumnRenamed("v", "base"), "base").join(heap_type, "heap")
    fields = hit.where("name is not null").join(resolve, ["t", "name"]).select("iid", F.concat_ws(":", F.lit("F"), "heap", "f").alias("loc"))
    return fields.union(hit.where("name is null").select("iid", F.concat_ws(":", F.lit("A"), "heap").alias("loc"))).distinct()


def accessible(local: DataFrame, call_edge: DataFrame) -> DataFrame:
    """(m, loc): locations that a procedure or any it calls may touch. ``local`` is (m, loc), calls (caller, callee)."""
    calls = settle(call_edge.select("caller", "callee").distinct())
    return follow(local.select("m", "loc"), lambda d: d.join(calls, d["m"] == calls["callee"]).select(F.col("caller").alias("m"), "loc"))


def local_access(field_locs: DataFrame, static_access: DataFrame, init_locs: DataFrame) -> DataFrame:
    """(m, loc): seeds of initialisers, static fields and everything instructions touch."""
    return union_all([f.select("m", F.col("loc").cast("string").alias("loc")) for f in (field_locs, static_access, init_locs)]).distinct()


def call_summaries(edges: DataFrame, entries: DataFrame, exits: DataFrame, calls: DataFrame, call_edge: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inter-procedural reachability: (m, bb) that execution may reach, and (m, kind) of exits that it may take.

    A block with a call (m, bb, site, is_static) goes on normally only if a callee returns, and exceptionally if one
    throws or, with a receiver, in any case; a call without callees goes on as it came.
    """
    no_calls = edges.join(calls.select("m", F.col("bb").alias("src")), ["m", "src"], "left_anti")
    known = calls.join(call_edge.select("site", "callee"), "site")
    free = calls.join(call_edge.select("site"), "site", "left_anti").select("m", F.col("bb").alias("src"))
    thrown_anyway = calls.where("not is_static").select("m", F.col("bb").alias("src")).distinct()
    open_edges = union_all([no_calls, edges.join(free.distinct(), ["m", "src"]), edges.where("kind = 'E'").join(thrown_anyway, ["m", "src"])]).select("m", "src", "dst", "kind").distinct()
    at_exit = exits.select("m", F.col("bb").alias("dst"))

    def after(b: DataFrame, x: DataFrame) -> DataFrame:
        """Edges out of reached calls whose callees take exits of the edge's kind."""
        hit = b.join(known.select("m", "bb", "callee"), ["m", "bb"]).join(x.select(F.col("m").alias("callee"), "kind"), "callee").select("m", F.col("bb").alias("src"), "kind").distinct()
        return edges.join(hit, ["m", "src", "kind"])

    def step(d, t):
        plain = d["block"].withColumnRenamed("bb", "src").join(open_edges, ["m", "src"])
        went = [plain, after(d["block"], t["exit"]), after(t["block"], d["exit"])]
        into = d["block"].join(known, ["m", "bb"]).select(F.col("callee").alias("m")).distinct().join(entries, "m")
        return {"block": [into.select("m", "bb"), *[w.select("m", F.col("dst").alias("bb")) for w in went]], "exit": [w.join(at_exit, ["m", "dst"]).select("m", "kind") for w in went]}

    spark = edges.sparkSession
    found = grow({"block": entries.join(roots, "m", "left_semi").select("m", "bb"), "exit": spark.createDataFrame([], "m long, kind string")}, step)
    return found["block"], found["exit"]


def unreachable_edges(edges: DataFrame, blocks: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """(m, src, dst) of edges that start in an unreached block or are known to be dead."""
    e = edges.select("m", "src", "dst").distinct()
    gone = e.join(blocks.select("m", F.col("bb").alias("src")), ["m", "src"], "left_anti")
    return gone if dead is None else gone.union(dead.select("m", "src", "dst")).distinct()


def constant_branches(branches: DataFrame) -> DataFrame:
    """(m, bb, taken): branches (m, bb, operator, left, right) on two constants; others are left out."""
    x, y, o = F.col("left"), F.col("right"), F.col("operator")
    taken = F.when(o == "EQ", x == y).when(o == "NE", x != y).when(o == "LT", x < y).when(o == "GE", x >= y).when(o == "GT", x > y).when(o == "LE", x <= y)
    return branches.select("m", "bb", taken.alias("taken")).where("taken is not null")


def dead_branches(branches: DataFrame, edges: DataFrame) -> DataFrame:
    """(m, src, dst): successors that constant branches never take."""
    found = branch_successors(branches.select("m", "bb"), edges).withColumnRenamed("taken", "is_true")
    return found.join(constant_branches(branches), ["m", "bb"]).where("is_true <> taken").select("m", F.col("bb").alias("src"), "dst")


def dominators(edges: DataFrame, entries: DataFrame, post: bool = False) -> DataFrame:
    """(m, bb, dom): strict and own dominators of reachable blocks; ``post`` turns edges round (entries are exits then).

    One method's graph is solved in one task: methods are bounded by the language, programs are not.
    """
    e = edges.select("m", F.col("dst" if post else "src").alias("src"), F.col("src" if post else "dst").alias("dst"), F.lit(False).alias("entry"))
    rows = e.unionByName(entries.select("m", F.col("bb").alias("src"), F.col("bb").alias("dst"), F.lit(True).alias("entry")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf["m"].iloc[0]
        starts = set(pdf.loc[pdf["entry"], "src"])
        preds: dict[int, set[int]] = {}
        succ: dict[int, list[int]] = {}
        for s, d in zip(pdf.loc[~pdf["entry"], "src"], pdf.loc[~pdf["entry"], "dst"]):
            succ.setdefault(s, []).append(d)
            preds.setdefault(d, set()).add(s)
        order, seen = [], set()
        todo = sorted(starts)
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                order.append(b)
                todo += succ.get(b, [])
        dom = {b: ({b} if b in starts else set(seen)) for b in order}
        moved = True
        while moved:
            moved = False
            for b in order:
                if b in starts:
                    continue
                new = {b} | set.intersection(*[dom[p] for p in preds[b] if p in seen])
                if new != dom[b]:
                    dom[b], moved = new, True
        return pd.DataFrame([(m, b, d) for b in order for d in dom[b]], columns=["m", "bb", "dom"])

    return rows.groupBy("m").applyInPandas(one, "m long, bb long, dom long")
