"""Data-flow and client-analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import lattices as L
from lattica.operators import analyses as A
from lattica.operators import dataflow as D
from lattica.operators import hierarchy as H
from lattica.operators import register as R
from lattica.plans.catalog import query
from lattica.plans.registration import _HANDLERS, _IMPLICIT, _SUB, _handlers, _instr
from lattica.sources.facts import encoded, oracle


@query(oracle("cfg_edge") + ", live AS (SELECT * FROM cfg_edge WHERE (src + m) % 23 <> 5), reach AS (SELECT DISTINCT m, CAST(0 AS BIGINT) AS bb FROM cfg_edge UNION SELECT e.m, e.dst FROM reach r JOIN live e ON r.m = e.m AND r.bb = e.src) SELECT m, bb FROM reach")
def df01_reachable_blocks(spark, sf_dir):
    e = encoded(spark, sf_dir, "cfg_edge")["cfg_edge"]
    return D.reachable_blocks(e, e.select("m", F.lit(0).cast("long").alias("bb")).distinct(), e.where("(src + m) % 23 = 5"))


@query(oracle("cfg_edge") + ", live AS (SELECT * FROM cfg_edge WHERE (src + m) % 23 <> 5), reach AS (SELECT DISTINCT m, CAST(0 AS BIGINT) AS bb FROM cfg_edge UNION SELECT e.m, e.dst FROM reach r JOIN live e ON r.m = e.m AND r.bb = e.src) SELECT DISTINCT m, src, dst FROM cfg_edge e WHERE (src + m) % 23 = 5 OR NOT EXISTS (SELECT 1 FROM reach r WHERE r.m = e.m AND r.bb = e.src)")
def reach06_unreachable_edges(spark, sf_dir):
    e = encoded(spark, sf_dir, "cfg_edge")["cfg_edge"]
    dead = e.where("(src + m) % 23 = 5")
    return D.unreachable_edges(e, D.reachable_blocks(e, e.select("m", F.lit(0).cast("long").alias("bb")).distinct(), dead), dead)


@query(oracle("cfg_edge", "ev") + ", r AS (SELECT DISTINCT m, bb, event_id % 7 AS slot FROM ev WHERE event_type = 'purchase' UNION SELECT e.m, e.dst, r.slot FROM r JOIN cfg_edge e ON r.m = e.m AND r.bb = e.src) SELECT m, bb, slot, TRUE AS value FROM r")
def df01_may_facts(spark, sf_dir):
    e = encoded(spark, sf_dir, "cfg_edge")["cfg_edge"]
    seed = spark.sql("SELECT DISTINCT m, CAST(bb AS BIGINT) AS bb, event_id % 7 AS slot, true AS value FROM ev WHERE event_type = 'purchase'")
    return D.solve_blocks(e, seed, {"value": L.join_may})


@query(oracle("cfg_edge", "ev") + ", r AS (SELECT DISTINCT m, bb, event_id % 7 AS slot FROM ev WHERE event_type = 'purchase' UNION SELECT e.m, e.src, r.slot FROM r JOIN cfg_edge e ON r.m = e.m AND r.bb = e.dst) SELECT m, bb, slot, TRUE AS value FROM r")
def df02_backward_facts(spark, sf_dir):
    e = encoded(spark, sf_dir, "cfg_edge")["cfg_edge"]
    seed = spark.sql("SELECT DISTINCT m, CAST(bb AS BIGINT) AS bb, event_id % 7 AS slot, true AS value FROM ev WHERE event_type = 'purchase'")
    return D.solve_blocks(e, seed, {"value": L.join_may}, backward=True)


@query(
    _HANDLERS + """, h AS (SELECT t.m, t.bb, t.type, c.bb AS dst, c.ord, c.type AS caught FROM (SELECT DISTINCT m, bb, type FROM thrown) t JOIN edges e ON e.m = t.m AND e.src = t.bb JOIN catches c ON c.m = e.m AND c.bb = e.dst),
  sure AS (SELECT m, bb, type, dst FROM h WHERE (caught, type) IN (SELECT (sup, sub) FROM up)),
  maybe AS (SELECT m, bb, type, dst FROM h WHERE bb % 2 = 0 AND (type, caught) IN (SELECT (sup, sub) FROM up))
  SELECT m, bb, type, dst FROM sure UNION SELECT m, bb, type, dst FROM maybe UNION SELECT m, bb, type, -1 FROM thrown t WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.m = t.m AND s.bb = t.bb AND s.type = t.type)"""
)
def df05_exc_successors(spark, sf_dir):
    thrown, edges, catches, sub = _handlers(spark, sf_dir)
    t = thrown.select("m", "bb", "type").distinct().withColumn("is_call", F.col("bb") % 2 == 0)
    return D.exception_successors(t, edges, catches, sub, thrown.select("m", F.lit(-1).cast("long").alias("bb")).distinct())


@query(oracle("cfg_edge", "instr") + " SELECT m, i.bb, e.dst, e.dst <> i.bb + 1 AS taken FROM instr i JOIN cfg_edge e USING (m) WHERE op = 'CONDITIONAL_BRANCH' AND e.src = i.bb AND kind = 'N'")
def df06_branch_successors(spark, sf_dir):
    e = encoded(spark, sf_dir, "cfg_edge")["cfg_edge"]
    return D.branch_successors(_instr(spark, sf_dir).where("op = 'CONDITIONAL_BRANCH'").select("m", "bb"), e)


@query(oracle("cfg_edge", "ev") + ", x AS (SELECT m, max(n_blocks) AS bb FROM ev GROUP BY m) SELECT m, kind, event_id % 5 AS slot, bool_and(event_id % 2 = 0) AS value FROM ev JOIN x USING (m) JOIN cfg_edge e USING (m) WHERE e.dst = x.bb AND e.src = ev.bb GROUP BY m, kind, event_id % 5")
def df09_exit_facts(spark, sf_dir):
    e = encoded(spark, sf_dir, "cfg_edge")["cfg_edge"]
    facts = spark.sql("SELECT m, CAST(bb AS BIGINT) AS bb, event_id % 5 AS slot, event_id % 2 = 0 AS value FROM ev")
    return D.exit_facts(facts, e, spark.sql("SELECT m, max(n_blocks) AS bb FROM ev GROUP BY m"), {"value": L.join_must})


@query("SELECT user_id AS m, CAST(event_id % 4 AS BIGINT) AS bb, max(event_id) AS iid FROM events GROUP BY ALL")
def df13_last_instruction(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("m"), (F.col("event_id") % 4).alias("bb"), F.col("event_id").alias("iid"), F.col("event_id").alias("idx"))
    return D.last_instruction(d)


@query(oracle("call", "local_access") + ", a AS (SELECT m, loc FROM local_access UNION SELECT caller, loc FROM a JOIN call ON callee = m) SELECT m, loc FROM a")
def acc03_closure(spark, sf_dir):
    f = encoded(spark, sf_dir, "call", "local_access")
    return D.accessible(f["local_access"], f["call"])


@query("SELECT o_orderkey AS iid, 'F:' || (l_suppkey) || ':' || (l_suppkey % 4 * 10 + o_orderkey % 2) AS loc FROM orders JOIN lineitem ON l_orderkey = o_custkey WHERE l_linenumber = 1 AND o_orderkey % 3 > 0 UNION SELECT o_orderkey, 'A:' || l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_custkey WHERE l_linenumber = 1 AND o_orderkey % 3 = 0")
def acc02_locations(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 1")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pts = li.select(F.col("l_orderkey").alias("v"), F.col("l_suppkey").alias("heap"))
    access = o.select(F.col("o_orderkey").alias("iid"), F.col("o_custkey").alias("base"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 2).alias("name"))
    resolve = spark.range(8).select((F.col("id") % 4).alias("t"), F.floor(F.col("id") / 4).alias("name"), (F.col("id") % 4 * 10 + F.floor(F.col("id") / 4)).alias("f"))
    return D.locations(pts, access, resolve, pts.select("heap", (F.col("heap") % 4).alias("t")).distinct())


_BRANCH = "SELECT m, bb, iid, u0 AS v, CASE iid % 6 WHEN 0 THEN 'EQ' WHEN 1 THEN 'NE' WHEN 2 THEN 'LT' WHEN 3 THEN 'GE' WHEN 4 THEN 'GT' ELSE 'LE' END AS operator, CASE WHEN iid % 4 > 0 THEN CAST(iid % 3 AS DOUBLE) END AS left, CASE WHEN iid % 5 > 0 THEN CAST(iid % 2 AS DOUBLE) END AS right FROM instr"
_BRANCH = _BRANCH.replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"')


def _branches(spark, sf_dir):
    encoded(spark, sf_dir, "instr")["instr"].createOrReplaceTempView("instr")
    return spark.sql(_BRANCH.replace('"', "`"))


_TAKEN = """CASE operator WHEN 'EQ' THEN "left" = "right" WHEN 'NE' THEN "left" <> "right" WHEN 'LT' THEN "left" < "right" WHEN 'GE' THEN "left" >= "right" WHEN 'GT' THEN "left" > "right" ELSE "left" <= "right" END"""


@query(oracle("instr") + f", b AS ({_BRANCH}) SELECT m, bb, {_TAKEN} AS taken FROM b WHERE \"left\" IS NOT NULL AND \"right\" IS NOT NULL")
def reach05_branch_fold(spark, sf_dir):
    return D.constant_branches(_branches(spark, sf_dir))


@query(oracle("instr", "cfg_edge") + f", b AS ({_BRANCH}) SELECT b.m, src, dst FROM b JOIN cfg_edge e ON e.m = b.m AND e.src = b.bb AND e.kind = 'N' WHERE \"left\" IS NOT NULL AND \"right\" IS NOT NULL AND (dst <> src + 1) <> ({_TAKEN})")
def reach05_dead_branches(spark, sf_dir):
    return D.dead_branches(_branches(spark, sf_dir), encoded(spark, sf_dir, "cfg_edge")["cfg_edge"])


# --- booleans --------------------------------------------------------------------------------------------------

_BITS = "SELECT event_id AS iid, CASE event_id % 3 WHEN 0 THEN 'and' WHEN 1 THEN 'or' ELSE 'xor' END AS op, CAST(event_id % 4 AS INT) AS a, CAST(user_id % 4 AS INT) AS b FROM events"


def _events(spark, sf_dir, sql):
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(sql)


@query(f"SELECT iid, CASE WHEN a = 0 OR b = 0 THEN 0 WHEN a = 3 OR b = 3 THEN 3 WHEN op = 'and' THEN CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 2 END WHEN op = 'or' THEN CASE WHEN a = 1 OR b = 1 THEN 1 ELSE 2 END ELSE CASE WHEN a <> b THEN 1 ELSE 2 END END AS value FROM ({_BITS})")
def bool01_operators(spark, sf_dir):
    return A.bool_binary(_events(spark, sf_dir, _BITS))


_CMP = "SELECT event_id AS iid, event_id % 6 AS u0, user_id % 6 AS u1, CASE WHEN event_id % 2 = 0 THEN event_id % 5 END AS c0, CASE WHEN user_id % 2 = 0 THEN user_id % 5 END AS c1 FROM events"


@query(f"SELECT iid, CASE WHEN u0 = u1 THEN 1 WHEN c0 IS NULL OR c1 IS NULL THEN 3 WHEN c0 = c1 THEN 1 ELSE 2 END AS value FROM ({_CMP})")
def bool02_comparison(spark, sf_dir):
    return A.bool_comparison(_events(spark, sf_dir, _CMP))


_INST = oracle("instr", "klass", "new", "nullc") + _SUB + ", tests AS (SELECT m, iid, u0 AS v, CAST(1 + iid % 5 AS BIGINT) AS type FROM instr WHERE op = 'INSTANCE_OF')"


@query(_INST + ", k AS (SELECT iid, bool_and((type, 100 + heap % 25) IN (SELECT (sup, sub) FROM up)) AS every, bool_or((type, 100 + heap % 25) IN (SELECT (sup, sub) FROM up)) AS any_ok FROM tests JOIN new USING (v) GROUP BY iid) SELECT iid, CASE WHEN (m, v) IN (SELECT (m, v) FROM nullc) THEN 2 WHEN every THEN 1 WHEN NOT any_ok THEN 2 ELSE 3 END AS value FROM tests LEFT JOIN k USING (iid)")
def bool03_instanceof(spark, sf_dir):
    f = encoded(spark, sf_dir, "instr", "klass", "new", "nullc")
    tests = f["instr"].where("op = 'INSTANCE_OF'").select("m", "iid", F.col("u0").alias("v"), (1 + F.col("iid") % 5).alias("type"))
    types = f["new"].select("heap", (100 + F.col("heap") % 25).alias("t")).distinct()
    return A.bool_instanceof(tests, f["new"], types, H.subtypes(f["klass"]), f["nullc"])


@query("SELECT user_id AS m, event_id % 10 AS def, bit_or(CAST(event_id % 4 AS INT)) AS value FROM events GROUP BY ALL")
def bool04_phi(spark, sf_dir):
    return A.bool_phi(_events(spark, sf_dir, "SELECT user_id AS m, event_id % 10 AS def, CAST(event_id % 4 AS INT) AS value FROM events"))


@query(oracle("instr") + f", b AS ({_BRANCH}) SELECT m, bb, v, taken, CASE WHEN (operator = 'EQ') = taken THEN 2 ELSE 1 END AS value FROM b, (VALUES (TRUE), (FALSE)) t(taken) WHERE operator IN ('EQ', 'NE')")
def bool05_branch(spark, sf_dir):
    return A.bool_branch(_branches(spark, sf_dir))


_CONST = "SELECT DISTINCT m, v, CASE v % 4 WHEN 0 THEN 'null' ELSE 'num' END AS kind, CAST(v % 3 AS DOUBLE) AS dval FROM nullc"


def _const(spark, sf_dir):
    encoded(spark, sf_dir, "nullc")["nullc"].createOrReplaceTempView("nullc")
    return spark.sql(_CONST)


@query(oracle("nullc", "instr") + f", c AS ({_CONST}) SELECT DISTINCT m, u1 AS v, CASE WHEN kind = 'num' THEN CASE dval WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END ELSE 3 END AS value FROM instr LEFT JOIN c ON c.m = instr.m AND c.v = u1 ".replace("SELECT DISTINCT m, u1", "SELECT DISTINCT instr.m, u1"))
def bool07_defaults(spark, sf_dir):
    c = _const(spark, sf_dir)
    asked = _instr(spark, sf_dir).select("m", F.col("u1").alias("v"), F.lit(None).cast("int").alias("value")).distinct()
    return A.bool_local(asked, c)


@query(f"SELECT iid, a AS v, a = 1 AS is_true, a IN (1, 2) AS is_constant FROM ({_BITS})")
def bool08_results(spark, sf_dir):
    return A.bool_results(_events(spark, sf_dir, _BITS).select("iid", F.col("a").alias("v"), F.col("a").alias("value")))


# --- non-null --------------------------------------------------------------------------------------------------

_DEREF = ", ".join(f"'{o}'" for o in A.DEREFERENCES)
_NEVER = ", ".join(f"'{o}'" for o in A.NEVER_NULL)


@query(oracle("instr") + f" SELECT m, bb, iid, u0 AS v, 'N' AS kind, TRUE AS nonnull FROM instr WHERE op IN ({_DEREF}) UNION ALL SELECT m, bb, iid, u0, 'E', FALSE FROM instr WHERE op IN ({_DEREF}) UNION ALL SELECT m, bb, iid, def, 'N', TRUE FROM instr WHERE op IN ({_NEVER}) UNION ALL SELECT m, bb, iid, u0, 'E', TRUE FROM instr WHERE op = 'CHECK_CAST'")
def nn07_dereferences(spark, sf_dir):
    return A.nonnull_transfer(_instr(spark, sf_dir))


@query(oracle("instr") + f", b AS ({_BRANCH}) SELECT m, bb, v, taken, (operator = 'NE') = taken AS nonnull FROM b, (VALUES (TRUE), (FALSE)) t(taken) WHERE operator IN ('EQ', 'NE')")
def nn09_null_branch(spark, sf_dir):
    return A.nonnull_branch(_branches(spark, sf_dir))


@query("SELECT user_id AS m, event_id % 10 AS def, bool_and(event_id % 7 > 0) AS nonnull FROM events GROUP BY ALL")
def nn06_phi(spark, sf_dir):
    return A.nonnull_phi(_events(spark, sf_dir, "SELECT user_id AS m, event_id % 10 AS def, event_id % 7 > 0 AS nonnull FROM events"))


@query(oracle("call") + ", act AS (SELECT caller * 1000000 + callee AS site, callee, i, (caller + i) % 4 > 0 AS nonnull FROM call, (VALUES (0), (1)) t(i)) SELECT callee AS m, 100 * callee + i AS v, bool_and(nonnull) AS nonnull FROM act GROUP BY callee, i")
def nn01_formals(spark, sf_dir):
    c = encoded(spark, sf_dir, "call")["call"].withColumn("site", F.col("caller") * 1_000_000 + F.col("callee"))
    act = c.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select("site", "i", ((F.col("caller") + F.col("i")) % 4 > 0).alias("nonnull"))
    formal = c.select(F.col("callee").alias("m")).distinct().withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select("m", "i", (100 * F.col("m") + F.col("i")).alias("v"))
    return A.nonnull_call(act, c.select("site", "callee"), formal)


@query(oracle("call", "meth") + " SELECT s.site, bool_and(coalesce(callee % 3 > 0, FALSE)) AS nonnull FROM (SELECT m AS site FROM meth) s LEFT JOIN call ON caller = s.site AND caller % 5 > 0 GROUP BY s.site")
def nn03_results(spark, sf_dir):
    f = encoded(spark, sf_dir, "call", "meth")
    c = f["call"]
    edges = c.where("caller % 5 > 0").select(F.col("caller").alias("site"), "callee")
    returned = c.select(F.col("callee").alias("m")).distinct().select("m", (F.col("m") % 3 > 0).alias("nonnull"))
    return A.nonnull_return(edges, returned, f["meth"].select(F.col("m").alias("site")))


@query(oracle("instr", "nullc", "prim") + f", c AS ({_CONST}) SELECT i.m, iid, u1 AS v, CASE WHEN kind = 'null' THEN FALSE WHEN kind IS NOT NULL OR (i.m, u1) IN (SELECT (m, v) FROM prim) OR u1 = 1 THEN TRUE ELSE iid % 4 = 0 END AS nonnull FROM instr i LEFT JOIN c ON c.m = i.m AND c.v = u1")
def nn14_query(spark, sf_dir):
    d = _instr(spark, sf_dir)
    asked = d.select("m", "iid", F.col("u1").alias("v"))
    known = asked.withColumn("nonnull", F.col("iid") % 4 == 0)
    this = d.select("m", F.lit(1).cast("long").alias("v")).distinct()
    return A.nonnull_query(asked, known, _const(spark, sf_dir), encoded(spark, sf_dir, "prim")["prim"], this)


# --- exceptions ------------------------------------------------------------------------------------------------


@query(oracle("instr") + f", {_IMPLICIT} SELECT m, bb, iid, type_name AS type FROM instr JOIN implicit USING (op) WHERE NOT (type_name = 'NullPointerException' AND iid % 3 = 0)")
def exc01_implicit(spark, sf_dir):
    d = _instr(spark, sf_dir)
    return A.implicit_exceptions(d, d.where("iid % 3 = 0").select("iid"))


@query(oracle("call", "meth") + ", x AS (SELECT m, CASE m % 3 WHEN 0 THEN 'NullPointerException' ELSE 'E' || CAST(m % 40 AS VARCHAR) END AS type FROM meth UNION SELECT caller, type FROM x JOIN call ON callee = m WHERE NOT (type = 'NullPointerException' AND (caller + callee) % 2 = 0)) SELECT m, type FROM x")
def exc02_call_union(spark, sf_dir):
    f = encoded(spark, sf_dir, "call", "meth")
    c, m = f["call"], F.col("m")
    own = f["meth"].select("m", F.when(m % 3 == 0, "NullPointerException").otherwise(F.concat(F.lit("E"), m % 40)).alias("type"))
    return A.call_exceptions(c, own, c.where("(caller + callee) % 2 = 0"))


@query(oracle("call", "meth") + " SELECT m AS site, 'RuntimeException' AS type FROM meth WHERE m NOT IN (SELECT caller FROM call) UNION SELECT m, 'D' || CAST(m * 3 % 25 AS VARCHAR) FROM meth WHERE m NOT IN (SELECT caller FROM call)")
def exc03_missing_receiver(spark, sf_dir):
    f = encoded(spark, sf_dir, "call", "meth")
    sites = f["meth"].select(F.col("m").alias("site"), (F.col("m") * 3 % 25).alias("target"))
    declared = spark.range(25).select(F.col("id").alias("m"), F.concat(F.lit("D"), "id").alias("type"))
    return A.missing_receiver(sites, f["call"].select(F.col("caller").alias("site"), "callee"), declared)


_KNOWN = "SELECT iid, CASE WHEN iid % 2 = 0 THEN iid % 9 - 1 END AS idx, CASE WHEN iid % 3 = 0 THEN iid % 7 END AS dim, CASE WHEN iid % 2 = 1 THEN iid % 3 END AS divisor FROM instr"


@query(oracle("instr") + f", {_IMPLICIT}, k AS ({_KNOWN}) SELECT m, bb, iid, type_name AS type FROM instr JOIN implicit USING (op) JOIN k USING (iid) WHERE NOT coalesce(type_name = 'ArrayIndexOutOfBoundsException' AND idx >= 0 AND idx < dim, FALSE) AND NOT coalesce(type_name = 'ArithmeticException' AND divisor <> 0, FALSE) AND NOT coalesce(type_name = 'NegativeArraySizeException' AND idx >= 0, FALSE)")
def exc04_constants(spark, sf_dir):
    d = _instr(spark, sf_dir)
    d.createOrReplaceTempView("instr")
    known = spark.sql(_KNOWN).withColumn("dims", F.array("idx"))
    return A.drop_by_constants(A.implicit_exceptions(d, d.where("false").select("iid")), known)


_CASTS = oracle("instr", "klass", "new", "nullc") + _SUB + ", casts AS (SELECT m, iid, u0 AS v, CAST(1 + iid % 5 AS BIGINT) AS type FROM instr WHERE op = 'CHECK_CAST')"


@query(_CASTS + " SELECT iid FROM casts c WHERE v IN (SELECT v FROM new) AND NOT EXISTS (SELECT 1 FROM new n WHERE n.v = c.v AND (c.type, 100 + heap % 25) NOT IN (SELECT (sup, sub) FROM up)) UNION SELECT iid FROM casts WHERE (m, v) IN (SELECT (m, v) FROM nullc)")
def exc07_removable_casts(spark, sf_dir):
    f = encoded(spark, sf_dir, "instr", "klass", "new", "nullc")
    casts = f["instr"].where("op = 'CHECK_CAST'").select("m", "iid", F.col("u0").alias("v"), (1 + F.col("iid") % 5).alias("type"))
    types = f["new"].select("heap", (100 + F.col("heap") % 25).alias("t")).distinct()
    return A.removable_casts(casts, f["new"], types, H.subtypes(f["klass"]), f["nullc"])


_WIDE = "widen(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in A.WIDENING.items() for b in a + bs) + ")"
_STORES = "SELECT m, iid, u1 AS v, CAST(1 + iid % 5 AS BIGINT) AS elem, CAST(100 + iid % 25 AS BIGINT) AS given, substr('BSCIJF', CAST(1 + iid % 6 AS INT), 1) AS given_name, substr('SIJFDX', CAST(1 + u0 % 6 AS INT), 1) AS elem_name FROM instr WHERE op = 'ARRAY_STORE'"


@query(oracle("instr", "klass", "nullc") + _SUB + f", {_WIDE}, s AS ({_STORES}) SELECT iid FROM s WHERE (m, v) IN (SELECT (m, v) FROM nullc) OR (given_name, elem_name) IN (SELECT (a, b) FROM widen) OR (elem, given) IN (SELECT (sup, sub) FROM up)")
def exc05_array_stores(spark, sf_dir):
    f = encoded(spark, sf_dir, "instr", "klass", "nullc")
    f["instr"].createOrReplaceTempView("instr")
    return A.safe_array_stores(spark.sql(_STORES), H.subtypes(f["klass"]), f["nullc"])


@query(oracle("instr") + f", {_IMPLICIT} SELECT m, bb AS src, count(DISTINCT type_name) AS n_types, string_agg(DISTINCT type_name, ',' ORDER BY type_name) AS types FROM instr JOIN implicit USING (op) GROUP BY m, bb")
def exc11_block_types(spark, sf_dir):
    d = R.generated_exceptions(_instr(spark, sf_dir))
    return A.throws_anything(d.select("m", F.col("bb").alias("src"), F.col("type_name").alias("type")))


# --- strings ---------------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE c AS (SELECT CAST(r_regionkey AS BIGINT) AS v, r_name AS val FROM region),
  a AS (SELECT 100 + n.n_nationkey AS after, n.n_regionkey AS before, (n.n_regionkey + 1) % 5 AS arg FROM nation n),
  s AS (SELECT after AS v, b.val || g.val AS val FROM a JOIN c b ON b.v = before JOIN c g ON g.v = arg),
  merged AS (SELECT CAST(200 + v % 4 AS BIGINT) AS v, val FROM s), every AS (SELECT * FROM c UNION SELECT * FROM s UNION SELECT * FROM merged)
  SELECT v, CASE WHEN count(DISTINCT val) >= 10 THEN '' ELSE string_agg(DISTINCT val, ',' ORDER BY val) END AS vals, count(DISTINCT val) >= 10 AS is_any FROM every GROUP BY v"""
)
def str04_append(spark, sf_dir):
    for t in ("region", "nation"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    const = spark.sql("SELECT CAST(r_regionkey AS BIGINT) AS v, r_name AS val, false AS is_any FROM region")
    append = spark.sql("SELECT CAST(100 + n_nationkey AS BIGINT) AS after, CAST(n_regionkey AS BIGINT) AS before, CAST((n_regionkey + 1) % 5 AS BIGINT) AS arg FROM nation")
    copy = append.select((200 + F.col("after") % 4).alias("dst"), F.col("after").alias("src"))
    return A.string_values(const, copy, append).select("v", F.array_join("vals", ",").alias("vals"), "is_any")


@query("SELECT CAST(c_nationkey AS BIGINT) AS v, CASE WHEN count(DISTINCT c_custkey % 14) >= 10 THEN '' ELSE string_agg(DISTINCT 's' || CAST(c_custkey % 14 AS VARCHAR), ',' ORDER BY 's' || CAST(c_custkey % 14 AS VARCHAR)) END AS vals, count(DISTINCT c_custkey % 14) >= 10 AS is_any FROM customer GROUP BY 1")
def str03_merge(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = c.select(F.col("c_nationkey").cast("long").alias("v"), F.array(F.concat(F.lit("s"), F.col("c_custkey") % 14)).alias("vals"), F.lit(False).alias("is_any"))
    vals, wide = L.join_strings("vals", "is_any")
    return rows.groupBy("v").agg(vals.alias("vals"), wide.alias("is_any")).select("v", F.array_join("vals", ",").alias("vals"), "is_any")
