"""Program dependence graphs, dominators and graph text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import dataflow as D
from lattica.operators import pdg as G
from lattica.plans.catalog import query
from lattica.plans.registration import _instr
from lattica.sources.facts import encoded, oracle

_TABLE = "(VALUES " + ", ".join(f"('{op}', {pos}, '{kind}')" for op, pos, kind in G.DATA_EDGES) + ") t(op, pos, type)"
_DATA = f"SELECT DISTINCT m, iid, CASE pos WHEN 0 THEN u0 ELSE u1 END AS src, coalesce(def, iid) AS dst, type FROM instr JOIN {_TABLE} USING (op)"


def _pc(spark, sf_dir):
    return _instr(spark, sf_dir).select("m", "bb", (-F.col("bb") - 1).alias("pc")).distinct()


@query(oracle("instr") + f" {_DATA}")
def pdg05_data_edges(spark, sf_dir):
    return G.data_edges(_instr(spark, sf_dir))


@query(oracle("instr") + " SELECT m, iid, -bb - 1 AS src, coalesce(def, iid) AS dst, 'IMPLICIT' AS type FROM instr")
def pdg05_implicit_edges(spark, sf_dir):
    return G.implicit_edges(_instr(spark, sf_dir), _pc(spark, sf_dir))


@query(
    oracle("instr") + """, r AS (SELECT DISTINCT m, bb, iid, type_ref AS t FROM instr WHERE op = 'CHECK_CAST')
  SELECT m, iid, CAST(-bb - 1 AS VARCHAR) AS src, 'T' || iid AS dst, 'TRUE' AS type FROM r UNION SELECT m, iid, CAST(-bb - 1 AS VARCHAR), 'F' || iid, 'FALSE' FROM r UNION SELECT m, iid, 'T' || iid, 'X' || iid || ':' || t, 'IMPLICIT' FROM r"""
)
def pdg04_exception_split(spark, sf_dir):
    raised = _instr(spark, sf_dir).where("op = 'CHECK_CAST'").select("m", "bb", "iid", F.col("type_ref").alias("type"))
    return G.exception_split(raised, _pc(spark, sf_dir))


@query(oracle("instr") + " SELECT m, CAST(u0 AS VARCHAR) AS src, 's' || iid AS dst, 'SWITCH' AS type FROM instr WHERE op = 'SWITCH' UNION ALL SELECT m, CAST(-bb - 1 AS VARCHAR), 's' || iid, 'CONJUNCTION' FROM instr WHERE op = 'SWITCH'")
def pdg08_switch(spark, sf_dir):
    return G.switch_edges(_instr(spark, sf_dir).where("op = 'SWITCH'").select("m", "bb", "iid", "u0"), _pc(spark, sf_dir))


@query(oracle("call") + " SELECT CAST(callee AS VARCHAR) AS src, CAST(1000 + callee AS VARCHAR) AS dst, 'MISSING' AS type FROM (SELECT DISTINCT callee FROM call) WHERE callee % 2 = 0")
def pdg13_native(spark, sf_dir):
    m = encoded(spark, sf_dir, "call")["call"].select(F.col("callee").alias("m")).distinct()
    return G.native_edges(m.where("m % 2 = 0"), m.select("m", F.col("m").alias("v")), m.select("m", F.lit("N").alias("kind"), (1000 + F.col("m")).alias("v")))


@query(
    oracle("instr") + f""", e AS (SELECT DISTINCT src, dst, type FROM ({_DATA})), n AS (SELECT DISTINCT def AS id, op AS type FROM instr)
  SELECT 'node' AS part, type, count(*) AS n FROM n GROUP BY ROLLUP (type) UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY ROLLUP (type)"""
)
def pdg15_counts(spark, sf_dir):
    i = _instr(spark, sf_dir)
    return G.counts(i.select(F.col("def").alias("id"), F.col("op").alias("type")), G.data_edges(i))


@query(oracle("instr") + f", e AS (SELECT DISTINCT src, dst, type FROM ({_DATA})), own AS (SELECT DISTINCT def AS id FROM instr WHERE m % 10 = 0) SELECT src, dst, type FROM e WHERE src IN (SELECT id FROM own) OR dst IN (SELECT id FROM own)")
def pdg16_subgraph(spark, sf_dir):
    i = _instr(spark, sf_dir)
    nodes = i.select(F.col("def").alias("id"), F.col("m").alias("grp")).distinct()
    return G.subgraph(nodes, G.data_edges(i).select("src", "dst", "type").distinct(), i.where("m % 10 = 0").select(F.col("m").alias("grp")).distinct())[1]


@query()
def pdg01_dominators(spark, sf_dir):
    e = encoded(spark, sf_dir, "cfg_edge")["cfg_edge"]
    return D.dominators(e, e.select("m", F.lit(0).cast("long").alias("bb")).distinct())


@query(oracle("call") + " SELECT '  n' || caller || ' -> n' || callee || ';' AS line FROM call")
def snk04_call_graph_dot(spark, sf_dir):
    c = encoded(spark, sf_dir, "call")["call"]
    return c.select(F.concat(F.lit("  n"), "caller", F.lit(" -> n"), "callee", F.lit(";")).alias("line"))


@query("SELECT DISTINCT p_name AS name, replace(p_name, ' ', '_') AS file, replace(p_name, '\"', '\\\"') AS label FROM part")
def snk07_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    return p.select("name", T.file_name(F.col("name")).alias("file"), T.dot_escape(F.col("name")).alias("label"))
