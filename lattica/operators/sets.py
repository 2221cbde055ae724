"""Sets and maps of integers as rows, arrays and bitmaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.fixpoint import minus, settle


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def bitmaps(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, bucket, bits): dense bit sets in buckets of fixed width, so no set is one value of unbounded size.

    Values are brought together before bits are set: a bucket's four kilobytes are neither shuffled nor sorted.
    """
    v = F.col(value)
    placed = rows.select(key, value).distinct().select(F.col(key), F.bitmap_bucket_number(v).alias("bucket"), F.bitmap_bit_position(v).alias("__at"))
    return placed.repartition(key, "bucket").groupBy(key, "bucket").agg(F.bitmap_construct_agg("__at").alias("bits"))


def bitmap_sizes(sets: DataFrame, key: str) -> DataFrame:
    return sets.groupBy(key).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def bitmap_union(sets: DataFrame, *keys: str) -> DataFrame:
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def contains_all(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of sets (k, x) with a a subset of b and a <> b.

    A superset holds the rarest element of its subset, so only the sets that hold it are candidates; of those, pairs whose
    sizes and signatures (a bit an element in 256) allow it are verified: they share as many elements as the subset has.
    """
    s = settle(sets.select("k", "x").distinct())
    often = s.groupBy("x").agg(F.count(F.lit(1)).alias("often"))
    h = F.xxhash64("x")
    bits = [F.bit_or(F.when(F.pmod(F.shiftright(h, 6), F.lit(4)) == i, F.expr("shiftleft(1L, cast(pmod(xxhash64(x), 64) as int))")).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(4)]
    of_set = settle(s.join(often, "x").groupBy("k").agg(F.min(F.struct("often", "x"))["x"].alias("rarest"), F.count(F.lit(1)).alias("n"), *bits))
    below = of_set.select(F.col("k").alias("a"), F.col("rarest").alias("x"), "n", *[F.col(f"s{i}").alias(f"a{i}") for i in range(4)])
    above = s.join(of_set, "k").select(F.col("k").alias("b"), "x", F.col("n").alias("__n"), *[f"s{i}" for i in range(4)])
    fits = reduce(Column.__and__, [F.col(f"a{i}").bitwiseAND(F.col(f"s{i}")) == F.col(f"a{i}") for i in range(4)])
    pairs = settle(below.join(above, "x").where((F.col("a") != F.col("b")) & (F.col("n") <= F.col("__n")) & fits).select("a", "b", "n"))
    several = pairs.where("n > 1")
    shared = several.join(s.withColumnRenamed("k", "a"), "a").join(s.withColumnRenamed("k", "b"), ["b", "x"])
    verified = shared.groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("shared")).where("shared = n")
    return pairs.where("n = 1").select("a", "b").union(verified.select("a", "b"))


def as_map(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """(by, entries): key-value rows of each ``by`` as one map; the smallest value of a repeated key."""
    one = rows.groupBy(by, key).agg(F.min(value).alias(value))
    return one.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("entries"))


def identical(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("x").alias("a"), F.col("x").alias("b")).distinct()


def swapped(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))


def product(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All pairs (key, a, b) of elements within one key."""
    return a.select(key, F.col("x").alias("a")).distinct().join(b.select(key, F.col("x").alias("b")).distinct(), key)


def work_queue(start: DataFrame, visit, most_rounds: int = 1000) -> DataFrame:
    """All items that ``visit`` (a frame of new items to a frame of items) leads to, each visited once."""
    seen = settle(start.distinct())
    new = seen
    for _ in range(most_rounds):
        new = settle(minus(visit(new).select(*seen.columns), seen))
        if new.isEmpty():
            return seen
        seen = settle(seen.union(new))
    raise RuntimeError(f"the queue did not empty in {most_rounds} rounds")


def filtered(pts: DataFrame, filters: DataFrame, heap_type: DataFrame, ok: DataFrame) -> DataFrame:
    """(v, heap) of a set seen through any of its type filters (v, filter)."""
    return pts.join(filters, "v").join(heap_type, "heap").join(ok, ["filter", "t"], "left_semi").select("v", "heap").distinct()


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
