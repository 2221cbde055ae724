"""Mixing sources to target weights with nested hash thresholds.

Every document has a 48-bit hash of its id. A source takes one copy of the documents whose hash lies below its
first threshold and a second copy below its second threshold; both thresholds come from histograms of sizes by
source and hash bucket, refined only inside the bucket where the budget runs out. Nothing is sorted, and a source
that holds a third of all rows is a few thousand partial sums like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import WORD, cut

HASH_BITS, STEP_BITS = 48, 12


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """48 bits of the MD5 of the id's decimal text; a null id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target): water-filling of ``share`` of all sizes by weight, capped at ``most`` sizes.

    One row a source. Sources rank by code point, null last, and weigh ``weights`` in turn.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = W.partitionBy()
    before = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("level", level)
    water = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    return levelled.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * water), F.col("cap")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, copy, below): for each source and copy, the hash below which documents are taken.

    ``budgets`` has (source, copy, budget). Each step looks only at the bucket in which the budget ran out before;
    the last step takes the boundary hash if that lands nearer to the budget than leaving it.
    """
    state = budgets.select("source", "copy", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("spent"))
    steps = HASH_BITS // STEP_BITS
    for step in range(1, steps + 1):
        left = HASH_BITS - step * STEP_BITS
        code = F.shiftright("h", left)
        found = state.withColumnRenamed("source", "b_source")
        inside = sized.join(found, sized["source"].eqNullSafe(found["b_source"]) & (F.shiftright("h", left + STEP_BITS) == F.col("prefix")))
        sums = inside.groupBy("source", "copy", "budget", "spent", code.alias("code")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(W.partitionBy("source", "copy").orderBy("code")) + F.col("spent")
        cum = sums.withColumn("upto", upto)
        crossing = F.col("upto") > F.col("budget")
        edge = cum.where(crossing).groupBy("source", "copy", "budget").agg(F.min(F.struct("code", "n", "upto")).alias("e"))
        state = cut(
            edge.select("source", "copy", "budget", F.col("e.code").alias("prefix"), (F.col("e.upto") - F.col("e.n")).alias("spent"), F.col("e.upto").alias("upto"))
        )
    nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("spent")
    return state.select("source", "copy", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``docs`` with size, source_size, target, copies (0, 1 or 2) and taken (size x copies) for each row.

    Null texts have size 0; null sources are one source, the last; repeated ids hash alike and are taken alike; a
    source without words has target 0; an empty table stays empty. Columns of ``docs`` with these names are replaced.
    """
    size = n_words(F.col("text")) if size is None else size
    sized = cut(docs.select("source", size.alias("size"), id_hash(F.col("doc_id")).alias("h")))
    plan = cut(targets(sized, weights, share, most))
    first, second = F.least("target", F.col("source_size").cast("double")), F.col("target") - F.col("source_size")
    budgets = plan.select("source", F.explode(F.array(F.struct(F.lit(1).alias("copy"), first.alias("budget")), F.struct(F.lit(2).alias("copy"), second.alias("budget")))).alias("b")).select("source", "b.copy", "b.budget")
    budgets = budgets.where((F.col("budget") > 0) & ~F.isnan("budget"))
    # A budget that covers all of a source never runs out and so finds no edge: everything lies below it.
    edges = thresholds(sized, budgets)
    whole = budgets.join(edges.withColumnRenamed("source", "e_source").withColumnRenamed("copy", "e_copy"), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("copy") == F.col("e_copy")), "left")
    below = whole.groupBy("source").agg(
        *[F.max(F.when(F.col("copy") == c, F.coalesce(F.col("below"), F.lit(1 << HASH_BITS).cast("long")))).alias(f"below{c}") for c in (1, 2)]
    )
    p, b = plan.withColumnRenamed("source", "p_source"), below.withColumnRenamed("source", "b_source")
    facts = cut(p.join(b, p["p_source"].eqNullSafe(b["b_source"]), "left").drop("b_source"))
    rows = docs.drop("size", "source_size", "target", "copies", "taken").withColumn("size", size).withColumn("__h", id_hash(F.col("doc_id")))
    h = F.col("__h")
    copies = (F.coalesce((h < F.col("below1")).cast("int"), F.lit(0)) + F.coalesce((h < F.col("below2")).cast("int"), F.lit(0))).cast("int")
    return (
        rows.join(facts, rows["source"].eqNullSafe(facts["p_source"]))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("__h", "p_source", "below1", "below2")
    )


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM per),
weighted AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
levelled AS (SELECT *, cap / weight AS ratio,
  (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighted),
water AS (SELECT arg_min(level, struct_pack(r := ratio, k := rank)) AS level FROM levelled WHERE ratio > level),
plan AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM water)), cap) AS target FROM levelled),
budgets AS (SELECT source, source_size, target, c, CASE c WHEN 1 THEN least(target, source_size::DOUBLE) ELSE target - source_size END AS budget FROM plan, (VALUES (1), (2)) v(c)),
cum AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS n FROM sized GROUP BY source, h),
edges AS (SELECT b.source, b.c, arg_min(CASE WHEN upto - budget < budget - (upto - n) THEN h + 1 ELSE h END, h) AS below
  FROM budgets b JOIN cum ON cum.source IS NOT DISTINCT FROM b.source WHERE upto > budget AND budget > 0 GROUP BY b.source, b.c),
bounds AS (SELECT b.source, b.source_size, b.target, b.c, CASE WHEN budget > 0 THEN coalesce(below, 281474976710656) ELSE 0 END AS below
  FROM budgets b LEFT JOIN edges e ON e.source IS NOT DISTINCT FROM b.source AND e.c = b.c)
SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target, (size * sum(CASE WHEN h < below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT row_number() OVER () AS r, * FROM sized) s JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source GROUP BY r, doc_id, size
"""
