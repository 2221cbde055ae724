"""The two loops on which every analysis rests: sets that only grow, and values that only rise.

A round is one Spark job per relation: joins against the last round's new rows, a distinct and an anti-join against what
is known. Rounds are written to the checkpoint folder as tables, so lineage stays flat, lost executors cost one round at
most, Spark knows each table's size (small new rows are broadcast, beyond Spark's threshold they are shuffled; see ``honest_sizes``), and the
write itself tells how many rows there are.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Relations = dict[str, DataFrame]


class RoundLimit(RuntimeError):
    """A fixpoint did not settle within its round limit."""


#: Bytes in memory for a byte of a Parquet file that Spark is to assume at least: sorted numbers shrink 50 times and more.
EXPANSION = 100
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def honest_sizes(spark: SparkSession, least: float = EXPANSION) -> None:
    """Judge tables by their rows' size, not by that of their compressed files: else millions of rows count as a small
    table and are broadcast through the driver. The session's factor only rises."""
    if float(spark.conf.get(_FACTOR, "1.0")) < least:
        spark.conf.set(_FACTOR, str(float(least)))


def _folder(spark: SparkSession) -> str:
    honest_sizes(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lattica-ckpt-"))
    return context.getCheckpointDir()


#: Types that take eight bytes of a row.
_PLAIN = ("long", "integer", "short", "byte", "double", "float", "boolean", "date", "timestamp")


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written to the shared checkpoint folder and read from there, and its number of rows."""
    spark, seen = df.sparkSession, Observation()
    path = f"{_folder(spark)}/round-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    n = seen.get["n"]
    size = n * sum(8 if f.dataType.typeName() in _PLAIN else 24 for f in df.schema) + 8 * n
    if size > 4 << 20:  # regular rows may shrink more than EXPANSION
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0]
        honest_sizes(spark, size / files)
    table = spark.read.schema(df.schema).parquet(path)
    # few rows in many files count as a large table by their files: they are known to be few
    few = n * sum(8 if f.dataType.typeName() in _PLAIN else 64 for f in df.schema) <= 2 << 20
    return table.hint("broadcast") if few else table, n


def settle(df: DataFrame) -> DataFrame:
    return counted(df)[0]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def minus(new: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct rows of ``new`` that ``known`` lacks; nulls compare equal. Both are shuffled once."""
    both = new.withColumn("__known", F.lit(False)).unionByName(known.select(*new.columns).withColumn("__known", F.lit(True)))
    return both.groupBy(*new.columns).agg(F.max("__known").alias("__known")).where("not __known").select(*new.columns)


def grow(seed: Relations, step: Callable[[Relations, Relations], dict[str, list[DataFrame]]], most_rounds: int = 1000, sparse: bool = False) -> Relations:
    """Least fixpoint of mutually recursive set rules, semi-naive.

    ``step(delta, total)`` lists, for each relation, frames of rows that follow from at least one row of ``delta``
    (``total`` includes ``delta``). Ends when no relation grows. With ``sparse``, ``delta`` leaves out relations
    without new rows, so that ``step`` need not plan rules that cannot fire.
    """
    first = {k: counted(v.distinct()) for k, v in seed.items()}
    total, parts = {k: v for k, (v, _) in first.items()}, {k: [v] for k, (v, _) in first.items()}
    delta = {k: v for k, (v, n) in first.items() if n or not sparse}
    for _ in range(most_rounds):
        fresh: Relations = {}
        for name, frames in step(delta, total).items():
            if frames:
                found, n = counted(minus(union_all([f.select(*total[name].columns) for f in frames]), total[name]))
                if n:
                    fresh[name] = found
        if not fresh:
            return total
        delta = dict(fresh) if sparse else {k: fresh.get(k, v.limit(0)) for k, v in total.items()}
        for name in total:
            if name in fresh:
                parts[name].append(fresh[name])
                if len(parts[name]) > 8:  # many small pieces become one
                    parts[name] = [settle(union_all(parts[name]))]
                total[name] = union_all(parts[name])
    raise RoundLimit(f"no fixpoint after {most_rounds} rounds")


def follow(seed: DataFrame, spread: Callable[[DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """Least set that holds ``seed`` and, with rows, what ``spread`` leads to from each of them alone.

    Steps are taken from the last step's distinct rows; they are compared with all that is known only once they are half
    as many, or eight steps old, so what is known is not shuffled in every step.
    """
    total, size = counted(seed.distinct())
    parts, new = [total], total
    for _ in range(most_rounds):
        steps, rows = [], 0
        while len(steps) < 8 and 2 * rows < size:
            new, n = counted(spread(new).select(*total.columns).distinct())
            if not n:
                break
            steps.append(new.withColumn("__step", F.lit(len(steps))))
            rows += n
        if not steps:
            return total
        fresh, n = counted(_first_steps(union_all(steps), total))
        if not n:
            return total
        parts.append(fresh.drop("__step"))
        if len(parts) > 8:  # many small pieces become one
            parts = [settle(union_all(parts))]
        total, size = union_all(parts), size + n
        # rows of earlier steps have been followed
        new = fresh.where(F.col("__step") == len(steps) - 1).drop("__step")
    raise RoundLimit(f"no fixpoint after {most_rounds} rounds")


def _first_steps(steps: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``steps`` that ``known`` lacks, each with the first step that met it."""
    columns = known.columns
    both = steps.unionByName(known.withColumn("__step", F.lit(-1)))
    return both.groupBy(*columns).agg(F.min("__step").alias("__step")).where("__step >= 0")


def closure(edges: DataFrame, seed: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, item): items of ``seed`` (node, item) carried along ``edges`` (src, dst); cycles are fine."""
    edges = settle(edges.select("src", "dst").distinct())
    spread = lambda d: d.join(edges, d["node"] == edges["src"]).select(F.col("dst").alias("node"), "item")
    return follow(seed.select("node", "item"), spread, most_rounds)


def rise(seed: DataFrame, keys: list[str], join: dict[str, Callable[[str], Column]], step: Callable[[DataFrame, DataFrame], DataFrame], widen: Callable[[DataFrame], DataFrame] = lambda d: d, most_rounds: int | None = None) -> DataFrame:
    """Least fixpoint of values: per ``keys`` one row, whose columns are joined by the aggregates in ``join``.

    ``step(changed, state)`` gives contributions that follow from the changed rows (``state`` includes them); ``widen`` is
    applied after each join. Only keys whose value changed are looked at again. The rounds end by themselves where values
    rise finitely often; ``most_rounds`` is for values of which that is not known.
    """
    fold = lambda d: widen(d.groupBy(*keys).agg(*[f(c).alias(c) for c, f in join.items()]))
    state = settle(fold(seed.select(*keys, *join)))
    changed, done = state, 0
    while True:
        new = settle(fold(step(changed, state).select(*keys, *join)))
        touched = state.join(new.select(*keys), keys, "left_semi")
        changed, n = counted(minus(fold(touched.unionByName(new)), touched))
        if not n:
            return state
        done += 1
        if done == most_rounds:
            raise RoundLimit(f"no fixpoint after {most_rounds} rounds")
        state = settle(state.join(changed.select(*keys), keys, "left_anti").unionByName(changed))
