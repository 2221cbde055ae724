"""Class hierarchy: subtype closure, dispatch, field resolution and type filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.fixpoint import closure, union_all


def subtypes(klass: DataFrame, implements: DataFrame | None = None) -> DataFrame:
    """Reflexive-transitive (sup, sub) of ``klass`` (t, super) and ``implements`` (t, iface)."""
    up = [klass.where("super is not null").select(F.col("super").alias("src"), F.col("t").alias("dst"))]
    if implements is not None:
        up.append(implements.select(F.col("iface").alias("src"), F.col("t").alias("dst")))
    ids = klass.select("t").union(*[u.select("src") for u in up[:1]]).distinct()
    found = closure(union_all(up).distinct(), ids.select(F.col("t").alias("node"), F.col("t").alias("item")))
    return found.select(F.col("item").alias("sup"), F.col("node").alias("sub"))


def dispatch(subtype: DataFrame, klass: DataFrame, method: DataFrame) -> DataFrame:
    """(t, selector, m): the method of the nearest superclass that declares the selector and is not abstract."""
    depth = subtype.groupBy("sub").agg(F.count(F.lit(1)).alias("depth"))
    m = method.where("not is_abstract and not is_static").select("m", "selector", "declaring")
    found = subtype.join(m, subtype["sup"] == m["declaring"]).join(depth.withColumnRenamed("sub", "d_sub"), F.col("sup") == F.col("d_sub"))
    return found.groupBy(F.col("sub").alias("t"), "selector").agg(F.max_by("m", F.struct("depth", "m")).alias("m"))


def resolve_fields(subtype: DataFrame, field: DataFrame) -> DataFrame:
    """(t, name, f): the field that a reference through type t means, the nearest declaration."""
    depth = subtype.groupBy(F.col("sub").alias("d_sub")).agg(F.count(F.lit(1)).alias("depth"))
    found = subtype.join(field.select("f", "declaring", "name"), subtype["sup"] == F.col("declaring")).join(depth, F.col("sup") == F.col("d_sub"))
    return found.groupBy(F.col("sub").alias("t"), "name").agg(F.max_by("f", F.struct("depth", "f")).alias("f"))


def filter_ok(filters: DataFrame, subtype: DataFrame) -> DataFrame:
    """(filter, t): types t that pass each filter (filter, is_type, not_types); semi-join and anti-join on subtypes."""
    yes = filters.join(subtype, filters["is_type"] == subtype["sup"]).select("filter", F.col("sub").alias("t"))
    bans = filters.select("filter", F.explode("not_types").alias("ban"))
    no = bans.join(subtype, bans["ban"] == subtype["sup"]).select("filter", F.col("sub").alias("t"))
    return yes.join(no, ["filter", "t"], "left_anti").distinct()


def impossible(filters: DataFrame, subtype: DataFrame) -> DataFrame:
    """Filters that no type passes: their type lies below one that they exclude."""
    bans = filters.select("filter", "is_type", F.explode("not_types").alias("ban"))
    return bans.join(subtype, (bans["ban"] == subtype["sup"]) & (bans["is_type"] == subtype["sub"])).select("filter").distinct()


def simplify_nots(filters: DataFrame, subtype: DataFrame) -> DataFrame:
    """(filter, ban) without bans that a wider ban of the same filter covers."""
    bans = filters.select("filter", F.explode("not_types").alias("ban")).distinct()
    strict = subtype.where("sup <> sub")
    wider = bans.withColumnRenamed("ban", "sup").join(strict, "sup").select("filter", F.col("sub").alias("ban"))
    return bans.join(wider, ["filter", "ban"], "left_anti")


def compose(a: DataFrame, b: DataFrame, subtype: DataFrame) -> DataFrame:
    """(filter, is_type, not_types) of both filters of a pair of frames joined by ``filter``: the narrower type, all bans.

    Types without a common subtype are left out: nothing passes both.
    """
    b = b.select("filter", F.col("is_type").alias("b_type"), F.col("not_types").alias("b_nots"))
    s1, s2 = (subtype.select(F.col("sup").alias(f"sup{i}"), F.col("sub").alias(f"sub{i}")) for i in (1, 2))
    both = a.join(b, "filter")
    below = both.join(s1, (F.col("is_type") == F.col("sup1")) & (F.col("b_type") == F.col("sub1")), "left").join(s2, (F.col("b_type") == F.col("sup2")) & (F.col("is_type") == F.col("sub2")), "left")
    narrow = F.when(F.col("sup1").isNotNull(), F.col("b_type")).when(F.col("sup2").isNotNull(), F.col("is_type"))
    return below.where(narrow.isNotNull()).select("filter", narrow.alias("is_type"), F.sort_array(F.array_union("not_types", "b_nots")).alias("not_types"))

