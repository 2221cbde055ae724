"""Lattices as aggregates and scalar columns: two-point, four-point booleans, intervals, bounded string sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four-point boolean lattice in two bits; join is bit-or.
NEITHER, TRUE, FALSE, UNKNOWN = 0, 1, 2, 3
#: Interval bounds beyond this lie at infinity, and sets of this many strings or more are any string.
WIDEN, MOST_STRINGS = 10.0, 10
INF = float("inf")


# two points: the boolean is true at the bottom or at the top, and so one of these joins it
def join_may(c: str) -> Column:
    return F.bool_or(c)


def join_must(c: str) -> Column:
    return F.bool_and(c)


# booleans
def join_bool(c: str) -> Column:
    return F.bit_or(c)


def bool_leq(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b) == b


def bool_op(op: str, a: Column, b: Column) -> Column:
    """and/or/xor of two-bit values; an unknown operand makes the result unknown, a missing one missing."""
    x, y = a == TRUE, b == TRUE
    value = {"and": x & y, "or": x | y, "xor": x != y}[op]
    return F.when((a == NEITHER) | (b == NEITHER), NEITHER).when((a == UNKNOWN) | (b == UNKNOWN), UNKNOWN).when(value, TRUE).otherwise(FALSE)


# intervals: columns lo, hi (doubles) and nan (boolean); bottom is null
def interval(lo: Column, hi: Column, nan: Column | None = None) -> Column:
    """A struct<lo, hi, nan> with bounds beyond the threshold moved to infinity."""
    low = F.when((lo > WIDEN) | (lo < -WIDEN), F.lit(-INF)).otherwise(lo.cast("double"))
    high = F.when((hi > WIDEN) | (hi < -WIDEN), F.lit(INF)).otherwise(hi.cast("double"))
    made = F.struct(low.alias("lo"), high.alias("hi"), (F.lit(False) if nan is None else nan).alias("nan"))
    return F.when(lo.isNotNull() & hi.isNotNull(), made)


def point(v: Column) -> Column:
    return F.when(F.isnan(v.cast("double")), top()).otherwise(interval(v, v))


def top() -> Column:
    return F.struct(F.lit(-INF).alias("lo"), F.lit(INF).alias("hi"), F.lit(True).alias("nan"))


def join_interval(c: str) -> Column:
    """Aggregate join; widening follows because the bounds pass through ``interval``."""
    return interval(F.min(f"{c}.lo"), F.max(f"{c}.hi"), F.bool_or(f"{c}.nan"))


def interval_leq(a: Column, b: Column) -> Column:
    return a.isNull() | (b.isNotNull() & (b["lo"] <= a["lo"]) & (a["hi"] <= b["hi"]))


def negate(a: Column) -> Column:
    return interval(-a["hi"], -a["lo"], a["nan"])


def has_zero(a: Column) -> Column:
    return (a["lo"] <= 0) & (a["hi"] >= 0)


def non_negative(a: Column) -> Column:
    return a["lo"] >= 0


def at_most(a: Column, n: Column) -> Column:
    """Refinement by ``<= n``: empty gives bottom, bottom gives the half line."""
    return F.when(a.isNull(), interval(F.lit(-INF), n)).when(a["lo"] <= n, interval(a["lo"], F.least(a["hi"], n), a["nan"]))


def at_least(a: Column, n: Column) -> Column:
    return F.when(a.isNull(), interval(n, F.lit(INF))).when(a["hi"] >= n, interval(F.greatest(a["lo"], n), a["hi"], a["nan"]))


def arithmetic(op: Column, a: Column, b: Column) -> Column:
    """ADD SUB MUL DIV REM AND OR XOR on intervals; null in, null out; a NaN bound gives the top."""

    def bounded(values: list[Column]) -> Column:
        bad = reduce(Column.__or__, [F.isnan(v) for v in values])
        return F.when(bad, top()).otherwise(interval(F.least(*values), F.greatest(*values), a["nan"] | b["nan"]))

    def corners(f: Callable[[Column, Column], Column]) -> list[Column]:
        return [f(a[i], b[j]) for i in ("lo", "hi") for j in ("lo", "hi")]

    # a divisor of zero is never divided by: those rows are the top before the quotient is looked at
    safe = lambda d: F.when(d == 0, F.lit(1.0)).otherwise(d)
    far = F.greatest(F.abs(b["lo"]), F.abs(b["hi"]))
    sums = lambda x, y: F.when(F.isnan(x) | F.isnan(y), top()).otherwise(interval(x, y, a["nan"] | b["nan"]))
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when(op == "ADD", sums(a["lo"] + b["lo"], a["hi"] + b["hi"]))
        .when(op == "SUB", sums(a["lo"] - b["hi"], a["hi"] - b["lo"]))
        .when(op == "MUL", bounded(corners(lambda x, y: x * y)))
        .when((op == "DIV") & has_zero(b), top())
        .when(op == "DIV", bounded(corners(lambda x, y: x / safe(y))))
        .when(op == "REM", interval(F.lit(0.0), far, a["nan"] | b["nan"]))
        .when(op.isin("AND", "OR", "XOR"), interval(F.lit(0.0), F.lit(1.0), F.lit(False)))
    )


# sets of strings: columns vals (sorted array) and is_any
def join_strings(vals: str, is_any: str, most: int = MOST_STRINGS) -> tuple[Column, Column]:
    """Aggregates for the union of string sets; too many strings are any string."""
    found = F.sort_array(F.array_distinct(F.flatten(F.collect_set(vals))))
    wide = F.bool_or(is_any) | (F.size(found) >= most)
    return F.when(wide, F.array().cast("array<string>")).otherwise(found), wide


def append_strings(a: Column, a_any: Column, b: Column, b_any: Column, most: int = MOST_STRINGS) -> tuple[Column, Column]:
    """All concatenations of a string of each set; any string if either set is, or if there are too many."""
    made = F.sort_array(F.array_distinct(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, y))))))
    wide = a_any | b_any | (F.size(made) >= most)
    return F.when(wide, F.array().cast("array<string>")).otherwise(made), wide
