"""Interval, lattice, collection and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import lattices as L
from lattica.operators import analyses as A
from lattica.operators import sets
from lattica.plans.catalog import query
from lattica.sources.facts import encoded, oracle

_OP = "CASE iid % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'SUB' WHEN 2 THEN 'DIV' ELSE 'REM' END"
_WIDE = "CASE WHEN {0} > 10 OR {0} < -10 THEN {1} ELSE {0} END"


def _widened(lo: str, hi: str) -> str:
    """(lo, hi) of an interval as SQL, with infinities as null."""
    return f"{_WIDE.format(lo, 'NULL')} AS lo, {_WIDE.format(hi, 'NULL')} AS hi"


def _finite(v: str):
    end = lambda c: F.when(F.abs(F.col(f"{v}.{c}")) < L.INF, F.round(F.col(f"{v}.{c}"), 6) + 0.0).alias(c)
    return [end("lo"), end("hi")]


def _operands(spark, sf_dir):
    encoded(spark, sf_dir, "iv")["iv"].createOrReplaceTempView("iv")
    rows = spark.sql(f"SELECT iid, {_OP} AS op, y AS alo, y + 2 AS ahi, CAST(iid % 3 AS DOUBLE) AS blo, CAST(iid % 3 + 1 AS DOUBLE) AS bhi FROM iv")
    return rows.select("iid", "op", L.interval(F.col("alo"), F.col("ahi")).alias("a"), L.interval(F.col("blo"), F.col("bhi")).alias("b"))


@query(
    oracle("iv") + f""", r AS (SELECT iid, {_OP} AS op, y AS alo, y + 2 AS ahi, CAST(iid % 3 AS DOUBLE) AS blo, CAST(iid % 3 + 1 AS DOUBLE) AS bhi FROM iv),
  s AS (SELECT iid, CASE op WHEN 'ADD' THEN alo + blo WHEN 'SUB' THEN alo - bhi WHEN 'REM' THEN 0.0 WHEN 'DIV' THEN CASE WHEN blo <= 0 THEN 99.0 ELSE least(alo / blo, alo / bhi, ahi / blo, ahi / bhi) END END AS l,
    CASE op WHEN 'ADD' THEN ahi + bhi WHEN 'SUB' THEN ahi - blo WHEN 'REM' THEN bhi WHEN 'DIV' THEN CASE WHEN blo <= 0 THEN 99.0 ELSE greatest(alo / blo, alo / bhi, ahi / blo, ahi / bhi) END END AS h FROM r)
  SELECT iid, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (SELECT iid, {_widened('l', 'h')} FROM s)"""
)
def iv02_interval_arith(spark, sf_dir):
    return A.interval_arithmetic(_operands(spark, sf_dir)).select("iid", *_finite("value"))


@query(oracle("iv") + " SELECT iid, 0 - (y + 2) AS lo, 0 - y AS hi FROM iv")
def iv03_negation(spark, sf_dir):
    iv = encoded(spark, sf_dir, "iv")["iv"]
    return iv.select("iid", L.negate(L.interval(F.col("y"), F.col("y") + 2)).alias("value")).select("iid", *_finite("value"))


@query(oracle("iv") + f", g AS (SELECT iid % 50 AS def, min(y) AS l, max(y + iid % 5) AS h FROM iv GROUP BY iid % 50) SELECT CAST(0 AS BIGINT) AS m, def, {_widened('l', 'h')} FROM g")
def iv04_phi(spark, sf_dir):
    iv = encoded(spark, sf_dir, "iv")["iv"]
    uses = iv.select(F.lit(0).cast("long").alias("m"), (F.col("iid") % 50).alias("def"), L.interval(F.col("y"), F.col("y") + F.col("iid") % 5).alias("value"))
    return A.interval_phi(uses).select("m", "def", *_finite("value"))


@query(oracle("iv") + ", g AS (SELECT iid % 70 AS loc, y FROM iv UNION ALL SELECT CAST(n_nationkey * 3 AS BIGINT), 0.0 FROM nation) SELECT loc, min(y) AS lo, max(y) AS hi FROM g GROUP BY loc")
def iv05_heap(spark, sf_dir):
    iv = encoded(spark, sf_dir, "iv")["iv"]
    news = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") * 3).cast("long").alias("loc"))
    return A.interval_heap(iv.select((F.col("iid") % 70).alias("loc"), L.point(F.col("y")).alias("value")), news).select("loc", *_finite("value"))


@query(
    oracle("iv") + """, r AS (SELECT iid, y, t AS taken, CASE iid % 3 WHEN 0 THEN 'EQ' WHEN 1 THEN 'GE' ELSE 'LT' END AS o FROM iv, (VALUES (TRUE), (FALSE)) x(t))
  SELECT iid AS v, taken, CASE WHEN o = 'EQ' AND taken THEN 1.0 WHEN o = 'EQ' THEN y WHEN (o = 'GE') = taken THEN CASE WHEN y + 3 >= 1 THEN greatest(y, 1.0) END ELSE CASE WHEN y <= 1 THEN y END END AS lo,
    CASE WHEN o = 'EQ' AND taken THEN 1.0 WHEN o = 'EQ' THEN y + 3 WHEN (o = 'GE') = taken THEN CASE WHEN y + 3 >= 1 THEN y + 3 END ELSE CASE WHEN y <= 1 THEN least(y + 3, 1.0) END END AS hi FROM r"""
)
def iv08_branch(spark, sf_dir):
    iv, zero = encoded(spark, sf_dir, "iv")["iv"], F.lit(0).cast("long")
    o = F.element_at(F.array(F.lit("EQ"), F.lit("GE"), F.lit("LT")), (F.col("iid") % 3 + 1).cast("int"))
    rows = iv.select(zero.alias("m"), zero.alias("bb"), F.col("iid").alias("v"), o.alias("operator"), L.interval(F.col("y"), F.col("y") + 3).alias("value"), F.lit(1.0).alias("bound"))
    return A.interval_branch(rows).select("v", "taken", *_finite("value"))


@query("SELECT user_id AS k, bool_or(event_id % 3 = 0) AS may, bool_and(event_id % 3 = 0) AS must, CAST(bit_or(1 + event_id % 2) AS INT) AS bool FROM events GROUP BY user_id")
def lat01_joins(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("k"), (F.col("event_id") % 3 == 0).alias("x"), (1 + F.col("event_id") % 2).cast("int").alias("b"))
    return e.groupBy("k").agg(L.join_may("x").alias("may"), L.join_must("x").alias("must"), L.join_bool("b").alias("bool"))


@query(
    """WITH s AS (SELECT o_custkey AS k, 's' || (o_orderkey % 30) AS x, o_orderkey % 400 = 0 AS wide FROM orders)
  SELECT k, CASE WHEN bool_or(wide) OR count(DISTINCT x) >= 10 THEN '' ELSE string_agg(DISTINCT x, ',' ORDER BY x) END AS vals, bool_or(wide) OR count(DISTINCT x) >= 10 AS is_any FROM s GROUP BY k"""
)
def lat07_string_sets(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), F.array(F.concat(F.lit("s"), F.col("o_orderkey") % 30)).alias("x"), (F.col("o_orderkey") % 400 == 0).alias("wide"))
    vals, wide = L.join_strings("x", "wide")
    return o.groupBy("k").agg(F.array_join(vals, ",").alias("vals"), wide.alias("is_any"))


# --- collections -----------------------------------------------------------------------------------------------

_A, _B = "SELECT DISTINCT l_partkey AS x FROM lineitem WHERE l_linenumber = 1", "SELECT DISTINCT l_partkey AS x FROM lineitem WHERE l_linenumber = 2"


def _two(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return tuple(li.where(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("x")) for n in (1, 2))


for _name, _word, _f in (("union", "UNION", sets.union), ("intersection", "INTERSECT", sets.intersection), ("difference", "EXCEPT", sets.difference)):
    query(f"{_A} {_word} {_B}", f"set01_{_name}")(lambda spark, sf_dir, f=_f: f(*_two(spark, sf_dir)))


@query("SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
def set02_bitmaps(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("x"))
    return sets.bitmap_sizes(sets.bitmaps(rows, "k", "x"), "k")


@query("WITH s AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS x FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY k) SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.x = b.x AND a.k <> b.k JOIN n ON n.k = a.k GROUP BY a.k, b.k, n.n HAVING count(*) = n.n")
def set02_subsets(spark, sf_dir):
    return sets.contains_all(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("x")))


# --- reports ---------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT event_id % 500 AS iid, bool_or(value > 50) AS bad FROM events GROUP BY event_id % 500) SELECT 'npe' AS counter, CAST(count_if(bad) AS BIGINT) AS bad, count(*) AS possible, count_if(bad) / count(*) AS ratio FROM e")
def agg01_null_checks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 500).alias("iid"), F.col("user_id").alias("ctx"), (F.col("value") > 50).alias("bad"))
    return A.collect(e, "npe")
