"""The dependence graph of the whole program of events: a method a user, a block an event, calls between users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import graph_text as X
from lattica.operators import pdg as G
from lattica.operators import pdg_graph as P
from lattica.operators.dataflow import dominators
from lattica.operators.fixpoint import settle
from lattica.plans.catalog import query
from lattica.sources.facts import encoded, oracle

FORMALS = 2


def program(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What ``pdg_graph.whole`` asks for."""
    f = encoded(spark, sf_dir, "instr", "flow", "exit_block", "target")
    sign = F.element_at(F.array(*[F.lit(x) for x in ("EQ", "NE", "LT", "GE", "GT", "LE")]), (F.col("iid") % 6 + 1).cast("int"))
    instr = settle(f["instr"].select("m", "bb", F.lit(0).alias("idx"), "iid", "op", "def", F.array("u0", "u1").alias("uses"), "type_ref", sign.alias("operator"), (F.col("u1") % 5 == 0).alias("zero")))
    method = settle(instr.select("m").distinct())
    formal = method.select("m", F.posexplode(F.array(*[F.lit(x).cast("long") for x in range(FORMALS)])).alias("i", "v"))
    return {
        "instr": instr, "edges": settle(f["flow"]), "entry": method.select("m", F.lit(0).cast("long").alias("bb")), "exit": settle(f["exit_block"]), "formal": formal,
        "raised": instr.where("op = 'CHECK_CAST'").select("m", "bb", "iid", F.col("type_ref").alias("type")), "call_edge": settle(f["target"]),
    }


#: Dominators by paths: d dominates b if every way from the start to b passes d, so that b is not reached around d.
_DOM = oracle("instr", "flow", "exit_block", "target") + """,
  blk AS (SELECT m, bb FROM instr UNION SELECT m, bb FROM exit_block),
  live AS (SELECT DISTINCT m, 0 AS bb FROM instr UNION SELECT f.m, f.dst FROM live l JOIN flow f ON f.m = l.m AND f.src = l.bb),
  around AS (SELECT m, bb AS d, 0 AS bb FROM blk WHERE bb <> 0 UNION SELECT a.m, a.d, f.dst FROM around a JOIN flow f ON f.m = a.m AND f.src = a.bb AND f.dst <> a.d),
  dom AS (SELECT l.m, l.bb, b.bb AS dom FROM live l JOIN blk b USING (m) WHERE (l.m, b.bb, l.bb) NOT IN (SELECT (m, d, bb) FROM around)),
  plive AS (SELECT m, bb FROM exit_block UNION SELECT f.m, f.src FROM plive l JOIN flow f ON f.m = l.m AND f.dst = l.bb),
  paround AS (SELECT e.m, b.bb AS d, e.bb FROM exit_block e JOIN blk b USING (m) WHERE b.bb <> e.bb UNION SELECT a.m, a.d, f.src FROM paround a JOIN flow f ON f.m = a.m AND f.dst = a.bb AND f.src <> a.d),
  post AS (SELECT l.m, l.bb, b.bb AS dom FROM plive l JOIN blk b USING (m) WHERE (l.m, b.bb, l.bb) NOT IN (SELECT (m, d, bb) FROM paround))"""
_TABLE = "(VALUES " + ", ".join(f"('{op}', {pos}, '{kind}')" for op, pos, kind in G.DATA_EDGES) + ") t(op, pos, type)"
_OWN = ", ".join(f"'{x}'" for x in P.OWN_RULES)
_GRAPH = _DOM + f""",
  i AS (SELECT n.m, n.bb, iid, op, def, u0, u1, type_ref AS t, CAST(iid % 6 = 0 AS BOOLEAN) AS eq, u1 % 5 = 0 AS zero, e.bb AS n FROM instr n JOIN exit_block e USING (m) JOIN live l ON l.m = n.m AND l.bb = n.bb),
  w AS (SELECT f.m, src, dst, kind, n, iid, op,
    CASE WHEN op = 'CONDITIONAL_BRANCH' THEN branch || iid WHEN op = 'SWITCH' THEN 's' || iid WHEN op LIKE 'INVOKE%' THEN 'j' || kind || iid WHEN op = 'CHECK_CAST' THEN CASE kind WHEN 'E' THEN 'T' ELSE 'F' END || iid END AS out,
    CASE WHEN kind = 'E' THEN CASE WHEN op LIKE 'INVOKE%' THEN 'x' || iid WHEN op = 'THROW' THEN CAST(def AS VARCHAR) ELSE 'X' || iid || ':' || t END END AS exc FROM flow f JOIN i ON i.m = f.m AND i.bb = f.src),
  met AS (SELECT m, dst AS bb, count(DISTINCT coalesce(out, CAST(src AS VARCHAR))) AS n, min(out) AS out, min(src) AS src FROM w GROUP BY 1, 2),
  cand AS (SELECT j.m, j.bb, d.dom FROM met j JOIN dom d ON d.m = j.m AND d.bb = j.bb JOIN post p ON p.m = j.m AND p.bb = d.dom AND p.dom = j.bb WHERE j.n > 1 AND d.dom <> j.bb),
  outer_cand AS (SELECT DISTINCT c.m, c.bb, o.dom FROM cand c JOIN dom o ON o.m = c.m AND o.bb = c.dom AND o.dom <> o.bb),
  rest AS (SELECT m, bb, min(dom) AS up FROM (SELECT * FROM cand EXCEPT SELECT * FROM outer_cand) GROUP BY 1, 2 HAVING count(*) = 1),
  own AS (SELECT m, bb, CASE WHEN bb = 0 THEN 'entry' WHEN up IS NOT NULL THEN NULL WHEN n = 1 THEN out ELSE 'p' || bb END AS pc, coalesce(up, src) AS up, bb <> 0 AND up IS NULL AND n > 1 AS is_merge
    FROM (SELECT m, 0 AS bb FROM instr UNION SELECT m, bb FROM met) LEFT JOIN met USING (m, bb) LEFT JOIN rest USING (m, bb)),
  pc AS (SELECT m, bb, pc FROM own WHERE pc IS NOT NULL UNION ALL SELECT o.m, o.bb, p.pc FROM pc p JOIN own o ON o.m = p.m AND o.up = p.bb WHERE o.pc IS NULL),
  wp AS (SELECT w.*, coalesce(out, pc.pc) AS c FROM w JOIN pc ON pc.m = w.m AND pc.bb = w.src),
  c AS (SELECT i.*, pc.pc FROM i JOIN pc ON pc.m = i.m AND pc.bb = i.bb),
  xin AS (SELECT DISTINCT m, dst AS bb, exc AS node FROM wp WHERE exc IS NOT NULL AND dst <> n),
  xn AS (SELECT m, bb, CASE WHEN count(*) > 1 THEN 'xm' || bb ELSE min(node) END AS node, count(*) AS k FROM xin GROUP BY 1, 2),
  ranked AS (SELECT m, dst AS bb, c, dense_rank() OVER (PARTITION BY m, dst ORDER BY src) - 1 AS i FROM wp),
  op AS (SELECT p.m, p.def, r.i, CASE r.i WHEN 0 THEN p.u0 ELSE p.u1 END AS v, r.c FROM c p JOIN ranked r ON r.m = p.m AND r.bb = p.bb WHERE p.op = 'PHI' AND r.i < 2),
  br AS (SELECT *, CASE WHEN zero THEN CAST(u0 AS VARCHAR) ELSE 'c' || iid END AS cond, zero AND eq AS turned FROM c WHERE op = 'CONDITIONAL_BRANCH'),
  call0 AS (SELECT m, iid AS site, pc, def, u0, u1 FROM c WHERE op LIKE 'INVOKE%'),
  args AS (SELECT *, 0 AS i, u0 AS v FROM call0 UNION ALL SELECT *, 1, u1 FROM call0),
  taken AS (SELECT DISTINCT m AS callee, kind FROM wp WHERE dst = n),
  sites AS (SELECT m, site, pc, 'N' AS kind, CAST(def AS VARCHAR) AS result FROM call0 UNION ALL SELECT m, site, pc, 'E', 'x' || site FROM call0),
  back AS (SELECT s.*, t.callee FROM sites s JOIN target t USING (site) JOIN taken k ON k.callee = t.callee AND k.kind = s.kind),
  tied AS (SELECT s.m, s.site, s.pc, s.kind, s.result, count(b.callee) AS n, CASE count(b.callee) WHEN 0 THEN s.kind || s.site WHEN 1 THEN s.kind || s.site || ':' || min(b.callee) ELSE s.kind || s.site || ':m' END AS tail
    FROM sites s LEFT JOIN back b ON b.site = s.site AND b.kind = s.kind GROUP BY 1, 2, 3, 4, 5),
  inner_edge AS (
    SELECT m, CAST(CASE pos WHEN 0 THEN u0 ELSE u1 END AS VARCHAR) AS src, CAST(def AS VARCHAR) AS dst, type FROM c JOIN {_TABLE} USING (op)
    UNION ALL SELECT m, pc, CAST(def AS VARCHAR), 'IMPLICIT' FROM c WHERE op NOT IN ({_OWN})
    UNION ALL SELECT m, pc, 'T' || iid, 'TRUE' FROM c WHERE op = 'CHECK_CAST' UNION ALL SELECT m, pc, 'F' || iid, 'FALSE' FROM c WHERE op = 'CHECK_CAST' UNION ALL SELECT m, 'T' || iid, 'X' || iid || ':' || t, 'IMPLICIT' FROM c WHERE op = 'CHECK_CAST'
    UNION ALL SELECT m, CAST(v AS VARCHAR), 't' || def || ':' || i, 'COPY' FROM op UNION ALL SELECT m, c, 't' || def || ':' || i, 'IMPLICIT' FROM op
    UNION ALL SELECT m, 't' || def || ':' || i, 'm' || def, 'MERGE' FROM op UNION ALL SELECT m, 'm' || def, CAST(def AS VARCHAR), 'COPY' FROM op
    UNION ALL SELECT m, CAST(u0 AS VARCHAR), cond, 'EXP' FROM br WHERE NOT zero UNION ALL SELECT m, CAST(u1 AS VARCHAR), cond, 'EXP' FROM br WHERE NOT zero
    UNION ALL SELECT m, cond, 'T' || iid, CASE WHEN turned THEN 'FALSE' ELSE 'TRUE' END FROM br UNION ALL SELECT m, cond, 'F' || iid, CASE WHEN turned THEN 'TRUE' ELSE 'FALSE' END FROM br
    UNION ALL SELECT m, pc, 'T' || iid, 'CONJUNCTION' FROM br UNION ALL SELECT m, pc, 'F' || iid, 'CONJUNCTION' FROM br
    UNION ALL SELECT m, CAST(u0 AS VARCHAR), 's' || iid, 'SWITCH' FROM c WHERE op = 'SWITCH' UNION ALL SELECT m, pc, 's' || iid, 'CONJUNCTION' FROM c WHERE op = 'SWITCH'
    UNION ALL SELECT wp.m, c, 'p' || bb, 'MERGE' FROM wp JOIN own ON own.m = wp.m AND own.bb = wp.dst AND is_merge WHERE wp.dst <> wp.n
    UNION ALL SELECT x.m, x.node, n.node, 'MERGE' FROM xin x JOIN xn n ON n.m = x.m AND n.bb = x.bb AND k > 1
    UNION ALL SELECT c.m, node, CAST(def AS VARCHAR), 'COPY' FROM c JOIN xn ON xn.m = c.m AND xn.bb = c.bb WHERE op = 'GET_CAUGHT_EXCEPTION'
    UNION ALL SELECT m, 'f0', '0', 'COPY' FROM instr UNION ALL SELECT m, 'f1', '1', 'COPY' FROM instr
    UNION ALL SELECT m, c, 'pc' || kind, 'MERGE' FROM wp WHERE dst = n UNION ALL SELECT m, exc, 'outE', 'MERGE' FROM wp WHERE dst = n AND exc IS NOT NULL
    UNION ALL SELECT i.m, CAST(i.def AS VARCHAR), 'outN', 'MERGE' FROM wp JOIN i ON i.m = wp.m AND i.bb = wp.src AND i.op = 'RETURN' WHERE dst = wp.n
    UNION ALL SELECT m, CAST(v AS VARCHAR), 'a' || site || ':' || i, 'COPY' FROM args UNION ALL SELECT m, pc, 'a' || site || ':' || i, 'IMPLICIT' FROM args
    UNION ALL SELECT m, pc, 'e' || kind || site || ':' || callee, 'CONJUNCTION' FROM back UNION ALL SELECT m, 'e' || kind || site || ':' || callee, 'r' || kind || site || ':' || callee, 'IMPLICIT' FROM back
    UNION ALL SELECT b.m, 'e' || b.kind || b.site || ':' || callee, 'e' || tail, 'MERGE' FROM back b JOIN tied t ON t.site = b.site AND t.kind = b.kind AND n > 1
    UNION ALL SELECT b.m, 'r' || b.kind || b.site || ':' || callee, 'r' || tail, 'MERGE' FROM back b JOIN tied t ON t.site = b.site AND t.kind = b.kind AND n > 1
    UNION ALL SELECT m, pc, 'e' || kind || site, 'CONJUNCTION' FROM tied WHERE n = 0 UNION ALL SELECT m, 'e' || tail, 'j' || kind || site, 'CONJUNCTION' FROM tied
    UNION ALL SELECT m, 'j' || kind || site, 'r' || kind || site, 'IMPLICIT' FROM tied WHERE n = 0 UNION ALL SELECT m, 'r' || tail, result, 'COPY' FROM tied),
  edge AS (
    SELECT m AS sm, src, m AS dm, dst, type, CAST(NULL AS VARCHAR) AS label_type, CAST(NULL AS BIGINT) AS label_id FROM inner_edge
    UNION SELECT a.m, 'a' || site || ':' || i, callee, 'f' || i, 'MERGE', 'ENTRY', site FROM args a JOIN target USING (site)
    UNION SELECT a.m, pc, callee, 'entry', 'MERGE', 'ENTRY', site FROM call0 a JOIN target USING (site)
    UNION SELECT callee, 'pc' || kind, m, 'e' || kind || site || ':' || callee, 'CONJUNCTION', 'EXIT', site FROM back
    UNION SELECT callee, 'out' || kind, m, 'r' || kind || site || ':' || callee, 'COPY', 'EXIT', site FROM back)"""
_KIND = "CASE regexp_extract(key, '^(entry|pcN|pcE|outN|outE|xm|[A-Za-z])', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.KINDS.items()) + " ELSE 'LOCAL' END"
_NODES = _GRAPH + f", node AS (SELECT m, key, {_KIND} AS type FROM (SELECT sm AS m, src AS key FROM edge UNION SELECT dm, dst FROM edge))"
_SHOWN = _NODES + """, named AS (SELECT *, CASE type WHEN 'LOCAL' THEN 'v' || key ELSE lower(type) END || ' of m' || m AS name FROM node),
  shown AS (SELECT *, name || CASE WHEN row_number() OVER w = 1 THEN '' ELSE ' (' || (row_number() OVER w - 1) || ')' END AS label FROM named WINDOW w AS (PARTITION BY name ORDER BY m, key))"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, m, key, type, name) and edges of the program's dependence graph."""
    edges = settle(P.whole(program(spark, sf_dir)))
    name = F.concat(F.when(F.col("type") == "LOCAL", F.concat(F.lit("v"), "key")).otherwise(F.lower("type")), F.lit(" of m"), "m")
    return P.nodes_of(edges).withColumn("name", name), edges


@query(_DOM + " SELECT m, bb, dom FROM dom")
def pdg01_flow_dominators(spark, sf_dir):
    p = program(spark, sf_dir)
    return dominators(p["edges"], p["entry"])


@query(_DOM + " SELECT m, bb, dom FROM post")
def pdg01_flow_post_dominators(spark, sf_dir):
    p = program(spark, sf_dir)
    return dominators(p["edges"], p["exit"], post=True)


@query(_GRAPH + " SELECT sm, src, dm, dst, type, label_type, label_id FROM edge")
def pdg12_program_graph(spark, sf_dir):
    """Edges of the whole graph: data, counters, phis, branches, exceptions, calls, exits and summaries."""
    return graph(spark, sf_dir)[1].drop("receivers")


@query(_NODES + " SELECT m, key, type FROM node")
def pdg14_program_nodes(spark, sf_dir):
    return graph(spark, sf_dir)[0].select("m", "key", "type")


@query(_NODES + " SELECT 'node' AS part, type, count(*) AS n FROM node GROUP BY ROLLUP (type) UNION ALL SELECT 'edge', type, count(*) FROM (SELECT DISTINCT sm, src, dm, dst, type FROM edge) GROUP BY ROLLUP (type)")
def pdg15_program_counts(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    ends = edges.select(G.node_id(F.col("sm"), F.col("src")).alias("src"), G.node_id(F.col("dm"), F.col("dst")).alias("dst"), "type")
    return G.counts(nodes, ends)


@query()
def snk01_program_json(spark, sf_dir):
    """Lines of the graph as one object of nodes and edges."""
    return X.graph_json(*graph(spark, sf_dir))


@query(
    _SHOWN + f""", style AS (SELECT *, CASE WHEN type IN ({", ".join(f"'{x}'" for x in P.COUNTERS)}) THEN '[style=filled, fillcolor=gray95]' ELSE '' END AS look FROM shown)
  SELECT chr(9) || chr(9) || '"' || label || '" ' || look AS line FROM style
  UNION ALL SELECT DISTINCT chr(9) || 'subgraph "cluster_m' || m || '"{{' FROM node UNION ALL SELECT DISTINCT chr(9) || 'label="m' || m || '";' FROM node UNION ALL SELECT chr(9) || '}}' FROM (SELECT DISTINCT m FROM node)
  UNION ALL SELECT chr(9) || '"' || s.label || '" -> "' || d.label || '" [label="' || e.type || CASE WHEN label_type IS NULL THEN '' ELSE ' ' || label_type || '-' || label_id END || '"];' FROM edge e JOIN shown s ON s.m = sm AND s.key = src JOIN shown d ON d.m = dm AND d.key = dst
  UNION ALL SELECT unnest(['digraph G {{', 'nodesep=1.0;', 'ranksep=1.0;', 'graph [fontsize=10];', 'node [fontsize=10];', 'edge [fontsize=10];', '}}'])"""
)
def snk02_program_dot(spark, sf_dir):
    """Lines of the graph in clusters of methods, nodes with equal names numbered."""
    nodes, edges = graph(spark, sf_dir)
    return X.graph_dot(nodes.withColumn("filled", F.col("type").isin(*P.COUNTERS)), edges).select("line")


_DOT = oracle("new", "assign") + """, pts AS (SELECT v, heap FROM new UNION SELECT dst, heap FROM pts JOIN assign ON v = src),
  n AS (SELECT DISTINCT v, '0v' AS k, coalesce(p_name, 'v' || v) AS name FROM pts LEFT JOIN part ON p_partkey = v UNION ALL SELECT DISTINCT heap, '1h', CASE WHEN heap % 10 = 0 THEN 'Exception' ELSE 'object' END || heap % 7 FROM pts),
  shown AS (SELECT v, k, name || CASE WHEN row_number() OVER w = 1 THEN '' ELSE ' (' || (row_number() OVER w - 1) || ')' END AS label, name FROM n WINDOW w AS (PARTITION BY name ORDER BY k, v))"""


@query(
    _DOT + """ SELECT chr(9) || '"' || replace(a.label, '"', '\\"') || '" -> "' || b.label || '";' AS line FROM pts JOIN shown a ON a.v = pts.v AND a.k = '0v' JOIN shown b ON b.v = heap AND b.k = '1h' WHERE NOT contains(b.name, 'Exception')
  UNION ALL SELECT unnest(['digraph G {', 'nodesep=1.0;', 'ranksep=1.0;', 'graph [fontsize=10];', 'node [fontsize=10];', 'edge [fontsize=10];', '}'])"""
)
def snk03_points_to_dot(spark, sf_dir):
    """Points-to sets as text: equal names are numbered, objects of suppressed names have no edges."""
    from lattica.operators.points_to import copy_closure

    f = encoded(spark, sf_dir, "new", "assign")
    pts = settle(copy_closure(f["new"], f["assign"]))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("v"), "p_name")
    names = pts.select("v").distinct().join(part, "v", "left").select("v", F.coalesce("p_name", F.concat(F.lit("v"), "v")).alias("name"))
    heaps = pts.select("heap").distinct().select("heap", F.concat(F.when(F.col("heap") % 10 == 0, "Exception").otherwise("object"), F.col("heap") % 7).alias("name"))
    return X.points_to_dot(pts, names, heaps).select("line")
