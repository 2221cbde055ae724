"""Points-to queries: closures, fields, filters, hierarchy, calls and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import contexts as C
from lattica.operators import hierarchy as H
from lattica.operators import points_to as P
from lattica.operators.fixpoint import closure
from lattica.plans.catalog import query
from lattica.sources.facts import encoded, oracle

_SUB = """, up AS (SELECT t AS sub, t AS sup FROM klass UNION SELECT up.sub, k.super FROM up JOIN klass k ON up.sup = k.t WHERE k.super IS NOT NULL)"""
_FILTERS = "SELECT CAST(r_regionkey AS BIGINT) AS filter, CAST(1 + r_regionkey AS BIGINT) AS is_type, CAST(100 + r_regionkey AS BIGINT) AS a, CAST(1000 + 100 * (r_regionkey + 5) + 9 AS BIGINT) AS b, CAST(1 + r_regionkey % 4 AS BIGINT) AS c FROM region"


@query(oracle("new", "assign") + ", pts AS (SELECT v, heap FROM new UNION SELECT dst, heap FROM pts JOIN assign ON v = src) SELECT v, heap FROM pts")
def pt18_copy_closure(spark, sf_dir):
    f = encoded(spark, sf_dir, "new", "assign")
    return P.copy_closure(f["new"], f["assign"])


@query(oracle("new", "cyclic") + ", pts AS (SELECT v, heap FROM new UNION SELECT dst, heap FROM pts JOIN cyclic ON v = src) SELECT v, heap FROM pts")
def pt19_cyclic_copies(spark, sf_dir):
    f = encoded(spark, sf_dir, "new", "cyclic")
    return P.copy_closure(f["new"], f["cyclic"])


@query(oracle("new", "assign") + ", pts AS (SELECT v, heap FROM new UNION SELECT dst, heap FROM pts JOIN assign ON v = src) SELECT v, count(*) AS n_heaps, min(heap) AS least FROM pts GROUP BY v")
def pt21_set_of_variable(spark, sf_dir):
    f = encoded(spark, sf_dir, "new", "assign")
    return P.copy_closure(f["new"], f["assign"]).groupBy("v").agg(F.count(F.lit(1)).alias("n_heaps"), F.min("heap").alias("least"))


_FIELDS = """, r(rel, a, b, c) AS (
  SELECT 'p', v, heap, CAST(0 AS BIGINT) FROM new_order
  UNION (
    SELECT 'p', e.dst, p.b, CAST(0 AS BIGINT) FROM r p JOIN copy_order e ON p.rel = 'p' AND p.a = e.src
    UNION SELECT 'p', l.dst, x.c, CAST(0 AS BIGINT) FROM r p JOIN load l ON p.rel = 'p' AND p.a = l.base JOIN recurring.r x ON x.rel = 'f' AND x.a = p.b AND x.b = l.f
    UNION SELECT 'p', l.dst, x.c, CAST(0 AS BIGINT) FROM recurring.r p JOIN load l ON p.rel = 'p' AND p.a = l.base JOIN r x ON x.rel = 'f' AND x.a = p.b AND x.b = l.f
    UNION SELECT 'f', p.b, s.f, q.b FROM r p JOIN store s ON p.rel = 'p' AND p.a = s.base JOIN recurring.r q ON q.rel = 'p' AND q.a = s.src
    UNION SELECT 'f', p.b, s.f, q.b FROM recurring.r p JOIN store s ON p.rel = 'p' AND p.a = s.base JOIN r q ON q.rel = 'p' AND q.a = s.src))"""
_FIELD_FACTS = ("new_order", "copy_order", "store", "load")


def _fields(spark, sf_dir, change=lambda d: d):
    f = encoded(spark, sf_dir, *_FIELD_FACTS)
    return P.field_closure(f["new_order"], f["copy_order"], change(f["store"]), change(f["load"]))


@query(oracle(*_FIELD_FACTS) + _FIELDS + " SELECT a AS v, b AS heap FROM r WHERE rel = 'p'")
def pt05_field_load(spark, sf_dir):
    return _fields(spark, sf_dir)["pts"]


@query(oracle(*_FIELD_FACTS) + _FIELDS + " SELECT a AS heap, b AS f, c AS heap2 FROM r WHERE rel = 'f'")
def pt06_field_store(spark, sf_dir):
    return _fields(spark, sf_dir)["fpts"]


_ARRAYS = _FIELDS.replace("AND x.b = l.f", "AND x.b = -1").replace("s.f, q.b", "CAST(-1 AS BIGINT), q.b")


@query(oracle(*_FIELD_FACTS) + _ARRAYS + " SELECT a AS v, b AS heap FROM r WHERE rel = 'p'")
def pt07_array_contents(spark, sf_dir):
    return _fields(spark, sf_dir, lambda d: d.withColumn("f", F.lit(P.CONTENTS).cast("long")))["pts"]


# --- hierarchy and filters -------------------------------------------------------------------------------------


def _hierarchy(spark, sf_dir):
    f = encoded(spark, sf_dir, "klass")
    return f["klass"], H.subtypes(f["klass"])


def _filters(spark):
    d = spark.sql(_FILTERS)
    return d.select("filter", "is_type", F.array("a", "b", "c").alias("not_types"))


@query(oracle("klass") + _SUB + " SELECT sup, sub FROM up")
def pt23_subtypes(spark, sf_dir):
    return _hierarchy(spark, sf_dir)[1]


_OK = f", fl AS ({_FILTERS}), ok AS (SELECT filter, u.sub AS t FROM fl JOIN up u ON u.sup = is_type WHERE NOT EXISTS (SELECT 1 FROM up x WHERE x.sub = u.sub AND x.sup IN (a, b, c)))"


@query(oracle("klass") + _SUB + _OK + " SELECT DISTINCT filter, t FROM ok")
def pt23_type_filter(spark, sf_dir):
    _, sub = _hierarchy(spark, sf_dir)
    return H.filter_ok(_filters(spark), sub)


@query(oracle("klass") + _SUB + f", fl AS ({_FILTERS}), bans AS (SELECT filter, a AS ban FROM fl UNION SELECT filter, b FROM fl UNION SELECT filter, c FROM fl) SELECT filter, ban FROM bans x WHERE NOT EXISTS (SELECT 1 FROM bans y JOIN up ON up.sup = y.ban AND up.sub = x.ban AND up.sup <> up.sub WHERE y.filter = x.filter)")
def pt24_simplify_nots(spark, sf_dir):
    _, sub = _hierarchy(spark, sf_dir)
    return H.simplify_nots(_filters(spark), sub)


@query(oracle("klass") + _SUB + f", fl AS ({_FILTERS}) SELECT DISTINCT filter FROM fl JOIN up ON up.sub = is_type AND up.sup IN (a, b, c)")
def pt23_impossible(spark, sf_dir):
    _, sub = _hierarchy(spark, sf_dir)
    return H.impossible(_filters(spark), sub)


_MASKED = "SELECT p_partkey AS src, CAST({half} AS BIGINT) AS dst, CASE WHEN p_partkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE p_partkey % 5 END AS filter FROM part WHERE p_partkey >= 2"


@query(
    oracle("klass", "new") + _SUB + _OK + f", masked AS ({_MASKED.format(half='p_partkey // 2')}), pts AS (SELECT v, heap FROM new UNION SELECT dst, heap FROM pts JOIN masked ON v = src WHERE filter IS NULL OR (filter, 100 + heap % 25) IN (SELECT (filter, t) FROM ok)) SELECT v, heap FROM pts"
)
def pt20_filtered_copies(spark, sf_dir):
    f = encoded(spark, sf_dir, "new", "assign")
    _, sub = _hierarchy(spark, sf_dir)
    types = f["new"].select("heap", (100 + F.col("heap") % 25).alias("t")).distinct()
    return P.filtered_closure(f["new"], spark.sql(_MASKED.format(half="floor(p_partkey / 2)")), types, H.filter_ok(_filters(spark), sub))


_METHODS = "SELECT t AS m, 's' || CAST(t % 2 AS VARCHAR(1)) AS selector, t AS declaring FROM klass WHERE t % 3 = 0 OR t < 3"


@query(oracle("klass") + _SUB + f", me AS ({_METHODS}), depth AS (SELECT sub, count(*) AS d FROM up GROUP BY sub) SELECT up.sub AS t, selector, arg_max(m, d.d) AS m FROM up JOIN me ON me.declaring = up.sup JOIN depth d ON d.sub = up.sup GROUP BY up.sub, selector")
def pt15_dispatch(spark, sf_dir):
    k, sub = _hierarchy(spark, sf_dir)
    k.createOrReplaceTempView("klass")
    me = spark.sql(_METHODS).withColumn("is_abstract", F.lit(False)).withColumn("is_static", F.lit(False))
    return H.dispatch(sub, k, me)


@query(oracle("klass") + _SUB + ", fi AS (SELECT t AS f, 'n' || CAST(t % 3 AS VARCHAR(1)) AS name, t AS declaring FROM klass WHERE t % 2 = 0), depth AS (SELECT sub, count(*) AS d FROM up GROUP BY sub) SELECT up.sub AS t, name, arg_max(f, d.d) AS f FROM up JOIN fi ON fi.declaring = up.sup JOIN depth d ON d.sub = up.sup GROUP BY up.sub, name")
def df12_resolve_fields(spark, sf_dir):
    k, sub = _hierarchy(spark, sf_dir)
    return H.resolve_fields(sub, k.where("t % 2 = 0").select(F.col("t").alias("f"), F.concat(F.lit("n"), F.col("t") % 3).alias("name"), F.col("t").alias("declaring")))


# --- calls -----------------------------------------------------------------------------------------------------


def _calls(spark, sf_dir):
    return encoded(spark, sf_dir, "call")["call"]


@query(oracle("call") + ", reach AS (SELECT CAST(0 AS BIGINT) AS m UNION SELECT callee FROM reach JOIN call ON caller = m) SELECT m FROM reach")
def pt22_reachable(spark, sf_dir):
    c = _calls(spark, sf_dir)
    return closure(c.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), spark.sql("SELECT CAST(0 AS BIGINT) AS node, 0 AS item")).select(F.col("node").alias("m"))


_SITE = 1_000_000


def _program(spark, sf_dir, haf=None):
    """The method of an order allocates one object and hands it, and what it was handed, to all that it calls."""
    f = encoded(spark, sf_dir, "call", "meth")
    c, ms = f["call"].withColumn("site", F.col("caller") * _SITE + F.col("callee")), f["meth"]
    null = F.lit(None).cast("long")
    tables = {
        "new": ms.select("m", F.col("m").alias("v"), F.col("m").alias("site")),
        "assign": ms.select("m", F.col("m").alias("dst"), (-1 - F.col("m")).alias("src"), null.alias("filter")),
        "call": c.select(F.col("caller").alias("m"), "site", F.lit("static").alias("dispatch"), F.col("callee").alias("target"), F.lit(None).cast("string").alias("selector"), null.alias("receiver"), null.alias("result"), null.alias("exc")),
        "actual": c.select("site", F.lit(0).alias("i"), F.col("caller").alias("v")),
        "formal": ms.select("m", F.lit(0).alias("i"), (-1 - F.col("m")).alias("v")),
        "alloc": ms.select(F.col("m").alias("site"), (F.col("m") % 7).alias("type"), F.lit("T").alias("type_name"), F.col("m").alias("alloc_class"), F.lit("A").alias("alloc_class_name")),
    }
    return P.Program(tables, spark.sql("SELECT CAST(0 AS BIGINT) AS m"), haf or C.Abstraction())


_STATIC = """, reach AS (SELECT CAST(0 AS BIGINT) AS m UNION SELECT callee FROM reach JOIN call ON caller = m),
moves AS (SELECT caller AS s, -1 - callee AS v FROM call WHERE caller IN (SELECT m FROM reach) UNION ALL SELECT -1 - m, m FROM meth),
pts AS (SELECT m AS v, m AS heap FROM reach UNION SELECT x.v, p.heap FROM pts p JOIN moves x ON x.s = p.v)"""


@query(oracle("call", "meth") + _STATIC + " SELECT v, heap FROM pts")
def pt13_static_calls(spark, sf_dir):
    return P.solve(_program(spark, sf_dir))["pts"].select("v", "heap")


@query(oracle("call", "meth") + _STATIC + " SELECT caller AS m, callee, CAST(1000000 * caller + callee AS BIGINT) AS site FROM call WHERE caller IN (SELECT m FROM reach)")
def pt16_call_graph(spark, sf_dir):
    return P.solve(_program(spark, sf_dir))["call_edge"].select("m", "callee", "site")


@query(
    oracle("call") + """, c1 AS (SELECT caller, callee, 1000000 * caller + callee AS site FROM call),
reach(m, ctx) AS (SELECT CAST(0 AS BIGINT), '' UNION SELECT callee, CAST(site AS VARCHAR) FROM reach JOIN c1 ON caller = m) SELECT m, ctx FROM reach"""
)
def haf03_call_site_contexts(spark, sf_dir):
    found = P.solve(_program(spark, sf_dir, C.CallSite(1)))["reachable"]
    return found.select("m", F.array_join("ctx", ",").alias("ctx"))


@query(oracle("call", "meth") + _STATIC + " SELECT 'call_edges' AS counter, count(*) AS n FROM call WHERE caller IN (SELECT m FROM reach) UNION ALL SELECT 'call_nodes', count(*) FROM reach UNION ALL SELECT 'edges', count(*) FROM pts UNION ALL SELECT 'nodes', count(DISTINCT v) FROM pts UNION ALL SELECT 'field_edges', 0")
def pt27_counters(spark, sf_dir):
    return P.counters(P.solve(_program(spark, sf_dir)))


@query(oracle("call") + " SELECT count(*) + 1 AS n FROM (SELECT callee FROM call UNION SELECT 0 UNION SELECT 77)")
def pt28_call_graph_nodes(spark, sf_dir):
    c = _calls(spark, sf_dir)
    one = lambda x: spark.sql(f"SELECT CAST({x} AS BIGINT) AS m")
    return P.call_graph_nodes(c, one(0), one(77))


@query(oracle("call") + " SELECT caller, string_agg(CAST(callee AS VARCHAR), ',' ORDER BY callee) AS callees FROM call GROUP BY caller")
def pt29_successors(spark, sf_dir):
    return P.successors(_calls(spark, sf_dir).withColumnRenamed("caller", "m")).select("caller", F.array_join("callees", ",").alias("callees"))


@query(oracle("call") + ", ours AS (SELECT * FROM call WHERE (caller + callee) % 3 <> 0 AND caller % 4 <> 1) SELECT caller, callee FROM call EXCEPT SELECT caller, callee FROM call WHERE (caller, callee) IN (SELECT (caller, callee) FROM ours) OR caller NOT IN (SELECT caller FROM ours UNION SELECT callee FROM ours)")
def pt30_compare_graphs(spark, sf_dir):
    c = _calls(spark, sf_dir)
    return P.compare_graphs(c.where("(caller + callee) % 3 <> 0 AND caller % 4 <> 1"), c)[0]


@query(oracle("cyclic") + ", tc AS (SELECT src, dst FROM cyclic UNION SELECT tc.src, c.dst FROM tc JOIN cyclic c ON tc.dst = c.src) SELECT a.src AS node, least(a.src, min(a.dst)) AS rep FROM tc a JOIN tc b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
def pt25_cycles(spark, sf_dir):
    return P.strongly_connected(encoded(spark, sf_dir, "cyclic")["cyclic"].select("src", "dst"))


# --- contexts --------------------------------------------------------------------------------------------------

_ROWS = """SELECT o_orderkey AS k, CAST(o_custkey % 7 AS BIGINT) AS c0, CAST(o_custkey % 11 AS BIGINT) AS c1, CAST(o_orderkey % 13 AS BIGINT) AS h0, CAST(o_orderkey AS BIGINT) AS site, o_orderstatus = 'F' AS is_static, CAST(o_custkey % 5 AS BIGINT) AS heap,
  CAST(o_custkey % 3 AS BIGINT) AS alloc_class, CAST(o_custkey % 4 AS BIGINT) AS heap_class,
  CASE o_custkey % 6 WHEN 0 THEN 'Ljava/util/List' WHEN 1 THEN 'Ljava/lang/String' WHEN 2 THEN 'Ljava/lang/StringBuilder' WHEN 3 THEN 'Ljava/io/PrintStream' WHEN 4 THEN 'Lorg/bouncycastle/Key' ELSE 'Lapp/A' END AS heap_class_name,
  CASE o_custkey % 5 WHEN 0 THEN 'Ljava/util/List' WHEN 1 THEN 'Lorg/bouncycastle/Util' ELSE 'Lapp/B' END AS alloc_class_name, o_orderkey % 4 = 0 AS is_init,
  CASE o_orderkey % 3 WHEN 0 THEN 'Lapp/A.f()V' WHEN 1 THEN 'Lorg/bouncycastle/Util.g()V' ELSE 'Lapp/Pack.intToBigEndian(I)V' END AS callee_name FROM orders"""


def _push(e: str, ctx: str, n: int) -> str:
    return f"list_slice(list_concat([coalesce({e}, -1)], {ctx}, [{', '.join(['-1'] * n)}]), 1, {n})"


_CTX, _HCTX, _NO = "[c0, c1]", "[h0]", "[]::BIGINT[]"
_CASES = {
    "haf01_stack": ("cs(3)", _push("site", _CTX, 3), _CTX),
    "haf02_insensitive": ("ContextInsensitive", _NO, _NO),
    "haf03_call_site": ("cs", _push("site", _CTX, 2), _CTX),
    "haf04_static_call_site": ("scs", _push("CASE WHEN is_static THEN site END", _CTX, 2), _CTX),
    "haf05_type_ctx": ("type", f"CASE WHEN is_static THEN {_CTX} ELSE {_push('alloc_class', _HCTX, 2)} END", "[c0]"),
    "haf06_full_object": ("full(1)", f"CASE WHEN is_static THEN {_CTX} ELSE {_push('heap', _HCTX, 2)} END", "[c0]"),
    "haf07_one_object": ("OneObjSensitive", f"CASE WHEN is_static THEN {_CTX} ELSE [heap] END", _NO),
    "haf08_init_object": ("InstanceInitFullObjSensitive", f"CASE WHEN NOT is_init THEN {_NO} WHEN is_static THEN {_CTX} ELSE {_push('heap', _HCTX, 2)} END", "[c0]"),
    "haf09_collections": ("CollectionsTypeSensitive", f"CASE WHEN NOT is_static AND contains(heap_class_name, 'Ljava/util') THEN {_push('alloc_class', _HCTX, 2)} ELSE {_NO} END", f"CASE WHEN contains(alloc_class_name, 'Ljava/util') THEN [c0] ELSE {_NO} END"),
    "haf10_strings": ("StringBuilderFullObjSensitive", f"CASE WHEN NOT is_static AND heap_class_name LIKE 'Ljava/lang/String%' THEN {_push('heap', _HCTX, 3)} ELSE {_NO} END", f"CASE WHEN heap_class_name LIKE 'Ljava/lang/String%' THEN {_CTX} ELSE {_NO} END"),
    "haf11_filtered_builders": ("FilterStringBuilderSpecialized", f"CASE WHEN is_static THEN {_CTX} ELSE [heap, h0, -1] END", "CASE WHEN heap_class_name = 'Ljava/lang/StringBuilder' THEN [c0, c1] ELSE [-1, c1] END"),
    "haf12_output_streams": ("CallSiteSensitiveOutputStream", _push("CASE WHEN NOT is_static AND (heap_class_name = 'Ljava/io/PrintStream' OR heap_class_name = 'Lapp/A' AND k % 2 = 0) THEN site END", _CTX, 5), _CTX),
    "haf13_named_call_sites": ("MagicCallSiteSensitive", _push("CASE WHEN contains(callee_name, 'bouncycastle') OR contains(callee_name, 'intToBigEndian') THEN site END", _CTX, 2), _CTX),
    "haf13_named_objects": ("MagicFullObjSensitive", f"CASE WHEN NOT is_static AND contains(heap_class_name, 'bouncycastle') THEN [heap, h0, -1] ELSE {_NO} END", f"CASE WHEN contains(heap_class_name, 'bouncycastle') OR contains(alloc_class_name, 'bouncycastle') THEN {_CTX} ELSE {_NO} END"),
    "haf15_receiver_type": ("WalaReceiverTypeContextSelector", f"CASE WHEN is_static THEN {_NO} ELSE [heap_class] END", _NO),
}


def _context_query(expression: str):
    def run(spark, sf_dir):
        spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
        d = spark.sql(_ROWS).withColumn("ctx", F.array("c0", "c1")).withColumn("hctx", F.array("h0"))
        above = F.when((F.col("heap_class_name") == "Lapp/A") & (F.col("k") % 2 == 0), F.array("heap_class_name", F.lit(C.PRINT_STREAM))).otherwise(F.array("heap_class_name"))
        d = d.withColumn("heap_supers", above)
        haf, row = C.parse(expression), {c: F.col(c) for c in d.columns}
        return d.select("k", F.array_join(haf.merge(row), ",").alias("merged"), F.array_join(haf.record(row), ",").alias("recorded"))

    return run


for _name, (_expr, _merge, _record) in _CASES.items():
    query(f"SELECT k, array_to_string({_merge}, ',') AS merged, array_to_string({_record}, ',') AS recorded FROM ({_ROWS})", _name)(_context_query(_expr))


@query(f"SELECT k, array_to_string(list_concat({_push('CASE WHEN is_static THEN site END', '[c0]', 2)}, [-2], CASE WHEN is_static THEN [c1] ELSE {_push('alloc_class', '[heap]', 2)} END), ',') AS merged, array_to_string([c0, -2, c1], ',') AS recorded FROM ({_ROWS})")
def haf14_product(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    d = spark.sql(_ROWS).withColumn("ctx", C.longs(F.col("c0"), C.SPLIT, F.col("c1"))).withColumn("hctx", C.longs(F.col("h0"), C.SPLIT, F.col("heap")))
    haf, row = C.parse("[scs(2) x type(2,1)]"), {c: F.col(c) for c in d.columns}
    return d.select("k", F.array_join(haf.merge(row), ",").alias("merged"), F.array_join(haf.record(row), ",").alias("recorded"))
