"""Precise exceptions over one encoding: a method an order, a block a line, handlers that throw on, calls between orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import exceptions as X
from lattica.operators.fixpoint import settle
from lattica.plans.catalog import query

TYPES = ("NullPointerException", "ClassCastException", "ArithmeticException", "IOException", "RuntimeException", "Exception")
_NAME = "CASE {0} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
EXIT = 1000
#: Block 0 leads to all lines; a returned line has a handler (100 + its number), and every fourth part's handler throws on.
_SQL = {
    "line": "SELECT DISTINCT l_orderkey AS m, CAST(l_linenumber AS BIGINT) AS bb, l_partkey AS a, l_suppkey AS b, l_returnflag AS flag FROM lineitem",
    "raised": f"SELECT m, bb, {_NAME.format('b % 6')} AS type FROM line WHERE b % 4 = 0 UNION SELECT m, 100 + bb, CASE WHEN a % 8 = 0 THEN 'RuntimeException' ELSE 'IOException' END FROM line WHERE flag = 'R' AND a % 4 = 0",
    "calls": "SELECT DISTINCT m, bb, CAST(floor(m / 8) AS BIGINT) AS callee, a % 3 = 0 AS safe FROM line WHERE b % 4 = 1",
    "catches": f"SELECT DISTINCT m, 100 + bb AS bb, {_NAME.format('a % 5')} AS type FROM line WHERE flag = 'R'",
    "edges": f"SELECT DISTINCT m, CAST(0 AS BIGINT) AS src, bb AS dst, 'N' AS kind FROM line UNION SELECT m, bb, CAST({EXIT} AS BIGINT), 'E' FROM line UNION SELECT m, bb, 100 + bb, 'E' FROM line WHERE flag = 'R' UNION SELECT m, 100 + bb, CAST({EXIT} AS BIGINT), 'E' FROM line WHERE flag = 'R'",
    "native": "SELECT o_orderkey AS m, CASE WHEN o_orderkey % 2 = 0 THEN 'IOException' ELSE 'RuntimeException' END AS type FROM orders WHERE o_orderkey NOT IN (SELECT m FROM line) UNION SELECT o_orderkey, 'RuntimeException' FROM orders WHERE o_orderkey NOT IN (SELECT m FROM line)",
}
_PAIRS = [("Exception", t) for t in TYPES] + [("RuntimeException", t) for t in TYPES[:3]] + [(t, t) for t in TYPES[:-1]]


def _native(spark, m: DataFrame) -> DataFrame:
    """The rows of ``_SQL["native"]``: its NOT IN, as Spark plans it, sends all lines through the driver; an anti-join does
    not. As there, a line without a number leaves no row."""
    o = spark.table("lattica_orders").select(F.col("o_orderkey").alias("m")).where("m is not null")
    alone = o.join(m, "m", "left_anti").join(F.broadcast(m.where("m is null").limit(1).select(F.lit(True).alias("unknown"))), F.col("unknown"), "left_anti")
    kinds = F.array(F.lit("RuntimeException"), F.when(F.col("m") % 2 == 0, "IOException").otherwise("RuntimeException"))
    return alone.select("m", F.explode(F.array_distinct(kinds)).alias("type")).distinct()


def _program(spark, sf_dir) -> X.Throwing:
    for t in ("lineitem", "orders"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"lattica_{t}")
    found = {}
    for name, sql in _SQL.items():
        text = sql.replace("FROM lineitem", "FROM lattica_lineitem").replace("FROM orders", "FROM lattica_orders").replace("FROM line ", "FROM lattica_line ").replace("FROM line)", "FROM lattica_line)")
        found[name] = spark.sql(text.replace("FROM line UNION", "FROM lattica_line UNION") if not text.endswith("FROM line") else text[: -len("line")] + "lattica_line")
        if name == "line":
            found[name] = settle(found[name])
            found[name].createOrReplaceTempView("lattica_line")
    m = settle(found["line"].select("m").distinct())
    at = lambda bb: m.select("m", F.lit(bb).cast("long").alias("bb"))
    found = {k: settle(d) for k, d in found.items() if k not in ("line", "native")} | {"native": settle(_native(spark, m))}
    return X.Throwing(found["raised"], found["calls"], found["edges"], found["catches"], spark.createDataFrame(_PAIRS, "sup string, sub string"), at(EXIT), at(0), found["native"])


_SUBTYPE = "subtype(sup, sub) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in sorted(set(_PAIRS))) + ")"


def _flow(n: int, raised: str, calls: str, dead: str | None) -> str:
    """CTEs e<n> (m, bb, type, dst) and x<n> (m, type) of one stratum."""
    alive = f" AND NOT EXISTS (SELECT 1 FROM {dead} d WHERE d.m = {{0}}.m AND d.src = {{0}}.bb AND d.dst = {{1}})" if dead else ""
    sure = "EXISTS (SELECT 1 FROM catches h JOIN subtype ON sup = h.type AND sub = {0}.type WHERE h.m = {0}.m AND h.bb = 100 + {0}.bb)"
    at = f"at{n}(m, bb, type, is_call) AS (SELECT m, bb, type, FALSE FROM {raised} UNION SELECT c.m, c.bb, x.type, TRUE FROM x{n} x JOIN {calls} c ON c.callee = x.m WHERE NOT (safe AND x.type = 'NullPointerException'))"
    leave = f"t.type FROM {{0}} WHERE NOT {sure.format('t')}{alive.format('t', EXIT)}"
    x = f"""x{n}(m, type) AS (SELECT m, type FROM native UNION SELECT t.m, {leave.format(raised + ' t')} UNION
      SELECT t.m, {leave.format(f"(SELECT c.m, c.bb, x.type FROM x{n} x JOIN {calls} c ON c.callee = x.m WHERE NOT (safe AND x.type = 'NullPointerException')) t")})"""
    e = f"""e{n} AS (SELECT DISTINCT t.m, t.bb, t.type, h.bb AS dst FROM at{n} t JOIN catches h ON h.m = t.m AND h.bb = 100 + t.bb JOIN subtype ON (sup = h.type AND sub = t.type) OR (is_call AND sup = t.type AND sub = h.type)
      WHERE TRUE{alive.format('t', 'h.bb')} UNION SELECT t.m, t.bb, t.type, {EXIT} FROM at{n} t WHERE NOT {sure.format('t')}{alive.format('t', EXIT)})"""
    return f"{x}, {at}, {e}"


def _dead(n: int) -> str:
    return f"dead{n} AS (SELECT DISTINCT m, src, dst FROM edges g WHERE kind = 'E' AND NOT EXISTS (SELECT 1 FROM e{n} e WHERE e.m = g.m AND e.bb = g.src AND e.dst = g.dst))"


_HEAD = "WITH RECURSIVE " + ", ".join(f"{k} AS ({v.replace('floor(m / 8)', 'm // 8')})" for k, v in _SQL.items()) + f", {_SUBTYPE}, " + _flow(1, "raised", "calls", None) + ", " + _dead(1)
_AGAIN = """, reached AS (SELECT m, bb FROM line UNION SELECT g.m, g.dst FROM edges g WHERE kind = 'E' AND NOT EXISTS (SELECT 1 FROM dead1 d WHERE d.m = g.m AND d.src = g.src AND d.dst = g.dst)),
raised2 AS (SELECT r.* FROM raised r JOIN reached USING (m, bb)), calls2 AS (SELECT c.* FROM calls c JOIN reached USING (m, bb)), """ + _flow(2, "raised2", "calls2", "dead1") + ", " + _dead(2)


@query(_HEAD + " SELECT m, bb, type, dst FROM e1")
def exc10_routed(spark, sf_dir):
    """Where exceptions go if every handler is taken to run."""
    return X.flow(_program(spark, sf_dir))[0]


@query(_HEAD + _AGAIN + " SELECT m, type FROM x2")
def exc12_leaving(spark, sf_dir):
    """What leaves each procedure once handlers that nothing reaches throw nothing."""
    return X.refine(_program(spark, sf_dir))[1]


@query(_HEAD + _AGAIN + " SELECT m, src, dst FROM dead2")
def reach04_dead_edges(spark, sf_dir):
    """Exceptional edges that no exception takes, the second run's included."""
    return X.refine(_program(spark, sf_dir))[2]
