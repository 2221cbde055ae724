"""Registration queries: instructions to statements, exceptions to handlers, discovery, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import hierarchy as H
from lattica.operators import register as R
from lattica.plans.catalog import query
from lattica.sources import facts as S
from lattica.sources.facts import encoded, oracle


def _instr(spark, sf_dir):
    return encoded(spark, sf_dir, "instr")["instr"].withColumn("uses", F.array("u0", "u1"))


def _statements(spark, sf_dir):
    f = encoded(spark, sf_dir, "prim", "nullc")
    return R.statements(_instr(spark, sf_dir), f["prim"], f["nullc"])


_HEAD = oracle("instr", "prim", "nullc")
_SKIP = "AND (m, {0}) NOT IN (SELECT (m, v) FROM nullc) AND (m, {0}) NOT IN (SELECT (m, v) FROM prim)"
_PRIM = "AND (m, {0}) NOT IN (SELECT (m, v) FROM prim)"
_STATEMENTS = {
    "reg01_array_load": ("aload", f"SELECT m, def AS dst, u0 AS base FROM instr WHERE op = 'ARRAY_LOAD' {_PRIM.format('def')}"),
    "reg02_array_store": ("astore", f"SELECT m, u0 AS base, u1 AS src FROM instr WHERE op = 'ARRAY_STORE' {_SKIP.format('u1')}"),
    "reg03_check_cast": ("cast", "SELECT m, def AS dst, u0 AS src, type_ref AS type FROM instr WHERE op = 'CHECK_CAST' AND (m, u0) NOT IN (SELECT (m, v) FROM nullc)"),
    "reg04_get_field": ("load", f"SELECT m, def AS dst, u0 AS base, field_ref AS f FROM instr WHERE op = 'GET_FIELD' {_PRIM.format('def')}"),
    "reg05_get_static": ("sload", f"SELECT m, def AS dst, field_ref AS f FROM instr WHERE op = 'GET_STATIC' {_PRIM.format('def')}"),
    "reg06_put_field": ("store", f"SELECT m, u0 AS base, field_ref AS f, u1 AS src FROM instr WHERE op = 'PUT_FIELD' {_SKIP.format('u1')}"),
    "reg07_put_static": ("sstore", f"SELECT m, field_ref AS f, u0 AS src FROM instr WHERE op = 'PUT_STATIC' {_SKIP.format('u0')}"),
    "reg10_new_object": ("new", "SELECT m, def AS v, site, type_ref AS type FROM instr WHERE op IN ('NEW_OBJECT', 'NEW_ARRAY')"),
    "reg11_phi": ("phi", f"SELECT DISTINCT m, dst, src FROM (SELECT m, def AS dst, u0 AS src FROM instr WHERE op = 'PHI' UNION SELECT m, def, u1 FROM instr WHERE op = 'PHI') x WHERE TRUE {_SKIP.format('src')}"),
    "reg12_metadata": ("metadata", "SELECT m, def AS dst, type_ref AS type FROM instr WHERE op = 'LOAD_METADATA'"),
    "reg13_return": ("ret", f"SELECT m, u0 AS src FROM instr WHERE op = 'RETURN' {_SKIP.format('u0')}"),
}


def _statement_query(table: str):
    return lambda spark, sf_dir: _statements(spark, sf_dir)[table]


for _name, (_table, _sql) in _STATEMENTS.items():
    query(f"{_HEAD} {_sql}", _name)(_statement_query(_table))

_CALL = """calls AS (SELECT m, iid, site, target, CASE op WHEN 'INVOKE_STATIC' THEN 'static' WHEN 'INVOKE_SPECIAL' THEN 'special' ELSE 'virtual' END AS dispatch, CASE WHEN op <> 'INVOKE_STATIC' THEN u0 END AS receiver, def AS result, u0, u1
  FROM instr WHERE op LIKE 'INVOKE%' AND NOT (op IN ('INVOKE_VIRTUAL', 'INVOKE_INTERFACE') AND (m, u0) IN (SELECT (m, v) FROM nullc)))"""


@query(f"{_HEAD}, {_CALL} SELECT m, iid, site, target, dispatch, receiver, result FROM calls")
def reg08_calls(spark, sf_dir):
    return _statements(spark, sf_dir)["call"].drop("uses")


@query(f"{_HEAD}, {_CALL} SELECT m, site, i, v FROM (SELECT m, site, 0 AS i, u0 AS v FROM calls UNION ALL SELECT m, site, 1, u1 FROM calls) x WHERE TRUE {_SKIP.format('v')}")
def reg08_actuals(spark, sf_dir):
    f = encoded(spark, sf_dir, "prim", "nullc")
    return R.actuals(_statements(spark, sf_dir)["call"], f["prim"].union(f["nullc"]))


@query(oracle("instr") + " SELECT site, unnest(range(1, iid % 4)) AS level, unnest(range(1, iid % 4)) - 1 AS outer, unnest(range(1, iid % 4)) AS inner FROM instr WHERE op = 'NEW_ARRAY'")
def reg09_inner_arrays(spark, sf_dir):
    d = _instr(spark, sf_dir).where("op = 'NEW_ARRAY'").withColumn("dims", (F.col("iid") % 4).cast("int"))
    return R.inner_arrays(d.select("site", "dims"))


@query(oracle("instr") + " SELECT m, def AS v, CASE WHEN type_ref < 5 THEN -type_ref - 1 ELSE site END AS site, type_ref AS type FROM instr WHERE op IN ('NEW_OBJECT', 'NEW_ARRAY')")
def reg10_single_allocations(spark, sf_dir):
    new = _statements(spark, sf_dir)["new"]
    return R.single_sites(new, new.where("type < 5").select("type"))


@query(oracle("instr") + " SELECT DISTINCT type_ref AS type, -type_ref - 1 AS v, -type_ref - 1 AS site FROM instr WHERE op IN ('NEW_OBJECT', 'NEW_ARRAY') AND type_ref < 5")
def reg20_singletons(spark, sf_dir):
    new = _statements(spark, sf_dir)["new"]
    return R.singletons(R.single_sites(new, new.where("type < 5").select("type")))


_STR = "SELECT DISTINCT m, v, 'str' AS kind, 's' || CAST(v % 10 AS VARCHAR(2)) AS sval FROM nullc"


@query(oracle("instr", "nullc") + f", c AS ({_STR}) SELECT DISTINCT m, v, sval FROM c WHERE (m, v) IN (SELECT (m, u0) FROM instr UNION SELECT (m, u1) FROM instr)")
def reg15_string_literals(spark, sf_dir):
    encoded(spark, sf_dir, "nullc")["nullc"].createOrReplaceTempView("nullc")
    return R.string_literals(spark.sql(_STR), _instr(spark, sf_dir))


_IMPLICIT = "implicit(op, type_name) AS (VALUES " + ", ".join(f"('{o}', '{t}')" for o, t in R.IMPLICIT) + ")"


@query(oracle("instr") + f", {_IMPLICIT} SELECT m, bb, iid, type_name FROM instr JOIN implicit USING (op)")
def reg16_generated_exceptions(spark, sf_dir):
    return R.generated_exceptions(_instr(spark, sf_dir))


# thrown types are nations; blocks have handlers for the nation, its region or the root
_SUB = ", up AS (SELECT t AS sub, t AS sup FROM klass UNION SELECT up.sub, k.super FROM up JOIN klass k ON up.sup = k.t WHERE k.super IS NOT NULL)"
_THROWS = "op IN ('THROW', 'ARRAY_LOAD', 'CHECK_CAST', 'GET_FIELD', 'INVOKE_VIRTUAL', 'NEW_ARRAY')"
_THROWN = f"SELECT m, bb, iid, CAST(100 + iid % 25 AS BIGINT) AS type FROM instr WHERE {_THROWS}"
_EDGES = f"SELECT m, bb AS src, CAST(bb * 3 + k AS BIGINT) AS dst, 'E' AS kind FROM instr, ks WHERE {_THROWS}"
_CATCH = f"SELECT m, CAST(bb * 3 + k AS BIGINT) AS bb, CAST(1 AS INT) AS ord, CAST(CASE k WHEN 0 THEN 100 + (iid + bb) % 25 WHEN 1 THEN 1 + (iid + bb) % 5 ELSE 0 END AS BIGINT) AS type FROM instr, ks WHERE {_THROWS} AND (k < 2 OR iid % 3 = 0)"
_KS = "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region WHERE r_regionkey < 3"


def _handlers(spark, sf_dir):
    f = encoded(spark, sf_dir, "instr", "klass")
    f["instr"].createOrReplaceTempView("instr")
    spark.sql(_KS).createOrReplaceTempView("ks")
    return spark.sql(_THROWN), spark.sql(_EDGES), spark.sql(_CATCH), H.subtypes(f["klass"])


_HANDLERS = oracle("instr", "klass") + _SUB + f", ks AS ({_KS}), thrown AS ({_THROWN}), edges AS ({_EDGES}), catches AS ({_CATCH})"


@query(
    _HANDLERS + """, walk AS (SELECT t.m, iid, t.bb, e.dst, t.type, c.ord, c.type AS caught, EXISTS (SELECT 1 FROM up WHERE sup = c.type AND sub = t.type) AS sure
    FROM thrown t JOIN edges e ON e.m = t.m AND e.src = t.bb JOIN catches c ON c.m = e.m AND c.bb = e.dst
    WHERE EXISTS (SELECT 1 FROM up WHERE (sup = c.type AND sub = t.type) OR (sub = c.type AND sup = t.type))),
  w2 AS (SELECT *, coalesce(bool_or(sure) OVER o, FALSE) AS ended, coalesce(list_sort(list_distinct(list(caught) OVER o)), []) AS nots FROM walk WINDOW o AS (PARTITION BY m, iid, type ORDER BY dst, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT m, iid, bb, dst, type, array_to_string(nots, ',') AS not_types, caught FROM w2 WHERE NOT ended
  UNION ALL SELECT m, iid, bb, NULL, type, coalesce((SELECT string_agg(DISTINCT CAST(caught AS VARCHAR), ',' ORDER BY CAST(caught AS VARCHAR)) FROM walk w WHERE w.m = t.m AND w.iid = t.iid AND w.type = t.type), ''), NULL FROM thrown t
  WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.m = t.m AND w.iid = t.iid AND w.type = t.type AND sure)"""
)
def reg14_catch_routing(spark, sf_dir):
    return R.catch_routing(*_handlers(spark, sf_dir)).withColumn("not_types", F.array_join("not_types", ","))


_TRIGGER = "SELECT iid, CAST(1000 + 100 * (iid % 25) + 9 AS BIGINT) AS t FROM instr WHERE op IN ('NEW_OBJECT', 'GET_STATIC')"
_CLINIT = "SELECT t AS m, t AS declaring, TRUE AS is_clinit FROM klass WHERE t % 2 = 0"


@query(oracle("instr", "klass") + _SUB + f", trig AS ({_TRIGGER}), ci AS ({_CLINIT}) SELECT DISTINCT i.m, ci.m AS clinit FROM trig JOIN up ON up.sub = trig.t JOIN ci ON ci.declaring = up.sup JOIN instr i ON i.iid = trig.iid")
def reg17_class_inits(spark, sf_dir):
    f = encoded(spark, sf_dir, "instr", "klass")
    for k in f:
        f[k].createOrReplaceTempView(k)
    return R.class_inits(spark.sql(_TRIGGER), f["instr"], f["klass"].withColumn("is_interface", F.lit(False)), spark.sql(_CLINIT))


_NATIVE = "SELECT CAST(n_nationkey AS BIGINT) AS m, n_nationkey % 3 = 0 AS is_native, CAST(n_regionkey - 1 AS BIGINT) AS ret_type FROM nation"


@query(f"WITH me AS ({_NATIVE}), de AS (SELECT m, m % 4 AS type FROM me) SELECT m, 'RET' AS kind, CAST(ret_type AS VARCHAR) AS type FROM me WHERE is_native AND ret_type >= 0 UNION ALL SELECT m, 'EX', CAST(type AS VARCHAR) FROM me JOIN de USING (m) WHERE is_native UNION ALL SELECT m, 'EX', 'RuntimeException' FROM me WHERE is_native")
def reg18_native_defaults(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation")
    me = spark.sql(_NATIVE)
    return R.native_defaults(me, me.select("m", (F.col("m") % 4).alias("type")))


@query(oracle("prim") + " SELECT m, CAST(bb AS INT) AS i, event_id AS dst FROM ev WHERE (m, event_id) NOT IN (SELECT (m, v) FROM prim)")
def reg19_formal_copies(spark, sf_dir):
    f = encoded(spark, sf_dir, "prim")
    return R.formal_copies(spark.sql("SELECT m, CAST(bb AS INT) AS i, event_id AS v FROM ev"), f["prim"])


_DISC = """, r(rel, a) AS (SELECT 'm', CAST(0 AS BIGINT) UNION (
  SELECT 'm', callee FROM r JOIN call ON rel = 'm' AND a = caller WHERE callee % 2 = 0
  UNION SELECT 't', CAST(a % 5 AS BIGINT) FROM r WHERE rel = 'm'
  UNION SELECT 'm', callee FROM r x JOIN call ON x.rel = 'm' AND x.a = caller JOIN recurring.r y ON y.rel = 't' AND y.a = callee % 5 WHERE callee % 2 = 1
  UNION SELECT 'm', callee FROM recurring.r x JOIN call ON x.rel = 'm' AND x.a = caller JOIN r y ON y.rel = 't' AND y.a = callee % 5 WHERE callee % 2 = 1))"""


@query(oracle("call") + _DISC + " SELECT rel, a FROM r")
def reg21_discovery(spark, sf_dir):
    c = encoded(spark, sf_dir, "call")["call"]
    odd = F.col("callee") % 2 == 1
    calls = c.select(F.col("caller").alias("m"), F.when(odd, "virtual").otherwise("static").alias("dispatch"), F.col("callee").alias("target"), F.when(odd, F.col("callee").cast("string")).alias("selector"))
    ms = c.select(F.col("caller").alias("m")).union(c.select("callee")).distinct()
    targets = ms.select((F.col("m") % 5).alias("t"), F.col("m").cast("string").alias("selector"), F.col("m").alias("callee"))
    reach, inst = R.discover(spark.sql("SELECT CAST(0 AS BIGINT) AS m"), calls, ms.select("m", (F.col("m") % 5).alias("t")), targets)
    return reach.select(F.lit("m").alias("rel"), F.col("m").alias("a")).union(inst.select(F.lit("t"), "t"))


@query("SELECT CAST(o_custkey % 20 AS BIGINT) AS m, CAST(o_custkey % 9 AS BIGINT) AS base, CAST(length(o_orderpriority) AS BIGINT) AS f, CAST(min(100000 + o_orderkey) AS BIGINT) AS def FROM orders GROUP BY 1, 2, 3")
def reg22_duplicates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s = o.select((F.col("o_custkey") % 20).alias("m"), F.lit("field").alias("kind"), F.array(F.col("o_custkey") % 9, F.length("o_orderpriority").cast("long")).alias("key"), (100000 + F.col("o_orderkey")).alias("def"))
    return R.unduplicate(s)[0].select("m", F.col("key")[0].alias("base"), F.col("key")[1].alias("f"), "def")


# --- sources ---------------------------------------------------------------------------------------------------


@query(oracle("instr") + " SELECT m, iid, CASE WHEN m % 3 = 0 THEN 'GOTO' ELSE op END AS op FROM instr WHERE m % 3 <> 0 OR bb = 0")
def src03_model_bodies(spark, sf_dir):
    real = encoded(spark, sf_dir, "instr")["instr"].select("m", "bb", "iid", "op")
    model = real.where("m % 3 = 0 and bb = 0").withColumn("op", F.lit("GOTO"))
    return S.substitute(real, model).select("m", "iid", "op")


@query(oracle("instr") + ", d AS (SELECT m, def AS v, iid AS def_iid FROM instr), u AS (SELECT DISTINCT m, v, iid AS use_iid FROM (SELECT m, u0 AS v, iid FROM instr UNION ALL SELECT m, u1, iid FROM instr)) SELECT m, v, def_iid, use_iid FROM d FULL JOIN u USING (m, v)")
def src04_def_use(spark, sf_dir):
    return S.def_use(_instr(spark, sf_dir)).select("m", "v", "def_iid", "use_iid")


@query(oracle("instr") + " SELECT iid, CASE WHEN type_ref < 8 THEN type_ref + 500 ELSE type_ref END AS type_ref FROM instr")
def src06_rewrite_types(spark, sf_dir):
    types = spark.range(8).select(F.col("id").alias("model"), (F.col("id") + 500).alias("real"))
    return S.rewrite_types(encoded(spark, sf_dir, "instr")["instr"].select("iid", "type_ref"), types)


@query(
    """WITH me AS (SELECT CAST(n_nationkey AS BIGINT) AS m, n_name AS name, n_nationkey % 3 AS arg, n_nationkey % 2 AS ret FROM nation),
  mo AS (SELECT CAST(n_nationkey AS BIGINT) AS model, 'NATION_' || CAST(n_nationkey % 7 AS VARCHAR) AS name, n_nationkey % 3 AS arg, n_nationkey % 2 AS ret FROM nation)
  SELECT m, arg_max(model, (CASE WHEN me.arg = mo.arg THEN 2 ELSE 0 END + CASE WHEN me.ret = mo.ret THEN 1 ELSE 0 END) * 1000 - model) AS model FROM me JOIN mo USING (name) GROUP BY m"""
)
def src05_model_resolution(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation")
    me = spark.sql("SELECT CAST(n_nationkey AS BIGINT) AS m, n_name AS name, concat('f(', n_nationkey % 3, ')') AS selector, CAST(0 AS BIGINT) AS declaring, CAST(n_nationkey % 2 AS BIGINT) AS ret_type FROM nation")
    mo = spark.sql("SELECT CAST(n_nationkey AS BIGINT) AS model, 'signatures/library/A' AS owner, concat('NATION_', n_nationkey % 7) AS name, CAST(n_nationkey % 2 AS STRING) AS ret, CAST(n_nationkey % 3 AS STRING) AS args FROM nation")
    return S.resolve_models(me, spark.sql("SELECT CAST(0 AS BIGINT) AS t, 'A' AS name"), mo)
