"""Dependence graphs by hand, and graphs written as files and read back."""

import gzip
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lattica.operators import graph_text as X
from lattica.operators import pdg as G
from lattica.operators import pdg_graph as P
from lattica.operators.fixpoint import settle

M, NO = 7, []


def program(spark):
    """Method 7: a condition, two sides, a join; a call of method 8 (returns) and of method 9, which only throws."""
    instr = [
        (M, 0, 0, 10, "CONDITIONAL_BRANCH", 10, [0, 1], "EQ", True), (M, 1, 0, 11, "BINARY_OP", 11, [0, 1], None, False), (M, 2, 0, 12, "UNARY_NEG_OP", 12, [0, 0], None, False),
        (M, 3, 0, 13, "PHI", 13, [11, 12], None, False), (M, 4, 0, 14, "INVOKE_VIRTUAL", 14, [13, 1], None, False), (M, 5, 0, 15, "RETURN", 15, [14, None], None, False),
        (8, 0, 0, 20, "RETURN", 20, [0, None], None, False), (9, 0, 0, 30, "THROW", 30, [0, None], None, False),
    ]
    edges = [(M, 0, 1, "N", "T"), (M, 0, 2, "N", "F"), (M, 1, 3, "N", None), (M, 2, 3, "N", None), (M, 3, 4, "N", None), (M, 4, 5, "N", None), (M, 4, 6, "E", None), (M, 5, 6, "N", None), (8, 0, 1, "N", None), (9, 0, 1, "E", None)]
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "instr": f(instr, "m long, bb long, idx int, iid long, op string, def long, uses array<long>, operator string, zero boolean"), "edges": f(edges, "m long, src long, dst long, kind string, branch string"),
        "entry": f([(M, 0), (8, 0), (9, 0)], "m long, bb long"), "exit": f([(M, 6), (8, 1), (9, 1)], "m long, bb long"), "raised": f(NO, "m long, bb long, iid long, type long"),
        "call_edge": f([(14, 8), (14, 9)], "site long, callee long"), "formal": f([(m, i, i) for m in (M, 8, 9) for i in (0, 1)], "m long, i int, v long"),
    }


@pytest.fixture(scope="module")
def graph(spark):
    return settle(P.whole(program(spark)))


def test_summaries_tie_methods(graph):
    edges = {(r.sm, r.src, r.dm, r.dst, r.type, r.label_type) for r in graph.collect()}
    inside = {(a, b, t) for m, a, n, b, t, x in edges if m == n == M}
    # the join after the condition runs under the method's own counter again: no counter is merged there
    assert ("entry", "a14:0", "IMPLICIT") in inside and not any(b.startswith("p") and b[1:].isdigit() for _, b, _ in inside)
    # `v == 0` turns the condition's sides round and needs no node of its own
    assert {("0", "T10", "FALSE"), ("0", "F10", "TRUE"), ("T10", "t13:0", "IMPLICIT"), ("F10", "t13:1", "IMPLICIT"), ("t13:0", "m13", "MERGE"), ("m13", "13", "COPY")} <= inside
    # method 8 alone returns, method 9 alone throws
    assert {(8, "outN", M, "rN14:8", "COPY", "EXIT"), (8, "pcN", M, "eN14:8", "CONJUNCTION", "EXIT"), (9, "outE", M, "rE14:9", "COPY", "EXIT"), (9, "pcE", M, "eE14:9", "CONJUNCTION", "EXIT")} <= edges
    assert not any(s == "pcE" and m == 8 or s == "pcN" and m == 9 for m, s, *_ in edges)
    assert {(M, "a14:1", 8, "f1", "MERGE", "ENTRY"), (M, "entry", 9, "entry", "MERGE", "ENTRY")} <= edges
    assert {("eN14:8", "jN14", "CONJUNCTION"), ("rN14:8", "14", "COPY"), ("x14", "outE", "MERGE"), ("jE14", "pcE", "MERGE"), ("15", "outN", "MERGE"), ("f0", "0", "COPY")} <= inside


def test_calls_without_callee_and_receivers(spark):
    p = program(spark)
    alone = {(r.src, r.dst, r.type) for r in P.whole({**p, "call_edge": p["call_edge"].limit(0)}).where("sm = 7").collect()}
    assert {("entry", "eN14", "CONJUNCTION"), ("eN14", "jN14", "CONJUNCTION"), ("jN14", "rN14", "IMPLICIT"), ("rN14", "14", "COPY")} <= alone
    seen = spark.createDataFrame([(14, 8, 5), (14, 8, 3), (14, 9, 4)], "site long, callee long, heap long")
    labels = {(r.sm, r.dm, r.label_type): r.receivers for r in P.whole(p, seen).where("label_type is not null").collect()}
    assert labels == {(M, 8, "ENTRY"): [3, 5], (8, M, "EXIT"): [3, 5], (M, 9, "ENTRY"): [4], (9, M, "EXIT"): [4]}


def test_array_copies_depend_on_contents(spark):
    calls = spark.createDataFrame([(1, 5, "arraycopy", [10, 11, 12, 13, 14], None), (2, 6, "intValue", [20], 21), (3, 7, "next", [30], 31)], "site long, t long, name string, uses array<long>, result long")
    found = G.inline_models(calls, spark.createDataFrame([(6,)], "t long"))
    assert {tuple(r) for r in found.collect()} == {("10", "12", "EXP"), ("20", "21", "EXP")}


def read(folder) -> str:
    return "".join(gzip.open(p, "rt").read() for p in sorted(Path(folder).glob("part-*")))


def test_json_is_read_back(spark, graph, tmp_path):
    edges = graph
    nodes = P.nodes_of(edges).withColumn("name", F.concat("key", F.lit('"\\'), "m"))
    texts = []
    for parts in (1, 7):
        X.write_lines(X.graph_json(nodes, edges), str(tmp_path / f"json{parts}"), parts=parts)
        texts.append(read(tmp_path / f"json{parts}"))
    assert texts[0] == texts[1]
    found = json.loads(re.sub(r"^(\{?\s+)(nodes|edges):", r'\1"\2":', texts[0], flags=re.M))
    ids = {n["nodeid"] for n in found["nodes"]}
    assert len(ids) == nodes.count() == len(found["nodes"]) and len(found["edges"]) == edges.count()
    assert all(e["source"] in ids and e["dest"] in ids for e in found["edges"])
    assert {e["label"]["type"] for e in found["edges"] if "label" in e} == {"ENTRY", "EXIT"} and found["nodes"][0]["position"] is None
    X.write_lines(X.graph_json(nodes.limit(0), edges.limit(0)), str(tmp_path / "none"))
    assert json.loads(read(tmp_path / "none").replace("nodes", '"nodes"').replace("edges", '"edges"')) == {"nodes": [], "edges": []}


def test_dot_numbers_equal_names_and_keeps_order(spark, graph, tmp_path):
    edges = graph
    nodes = P.nodes_of(edges).withColumn("name", F.lower("type")).withColumn("filled", F.col("type").isin(*P.COUNTERS))
    texts = []
    for parts in (1, 5):
        n = nodes.coalesce(1) if parts == 1 else nodes.repartition(9)
        X.write_lines(X.graph_dot(n, edges), str(tmp_path / f"dot{parts}"), parts=parts)
        texts.append(read(tmp_path / f"dot{parts}"))
    assert texts[0] == texts[1]
    lines = texts[0].splitlines()
    assert lines[:2] == ["digraph G {", "nodesep=1.0;"] and lines[-1] == "}" and lines.count("\t}") == 3
    shown = re.findall(r'^\t\t"([^"]*)"', texts[0], flags=re.M)
    n_formals = nodes.where("type = 'FORMAL_SUMMARY'").count()
    assert len(set(shown)) == len(shown) == nodes.count() and {x for x in shown if x.startswith("formal_summary")} == {"formal_summary"} | {f"formal_summary ({i})" for i in range(1, n_formals)}
    drawn = re.findall(r'^\t"([^"]*)" -> "([^"]*)"', texts[0], flags=re.M)
    assert len(drawn) == edges.count() and {x for e in drawn for x in e} == set(shown)
    one = X.graph_dot(nodes, edges, methods=spark.createDataFrame([(8,)], "m long")).where("line like '%subgraph%'").collect()
    assert {r.line for r in one} == {'\tsubgraph "cluster_m7"{', '\tsubgraph "cluster_m8"{'}


def test_one_name_over_many_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4900, "same").otherwise(F.concat(F.lit("n"), "id")).alias("name"), "id")
    found = {r.id: r.label for r in X.numbered(rows, "name", "id").collect()}
    assert found[0] == "same" and all(found[i] == f"same ({i})" for i in range(1, 4900)) and found[4950] == "n4950"


def test_suppressed_objects_have_no_edges(spark):
    pts = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "v long, heap long")
    names = spark.createDataFrame([(1, "x"), (2, "x")], "v long, name string")
    heaps = spark.createDataFrame([(10, "x"), (11, "java.lang.Exception")], "heap long, name string")
    assert sorted(r.line for r in X.points_to_dot(pts, names, heaps).where("line like '%->%'").collect()) == ['\t"x (1)" -> "x (2)";', '\t"x" -> "x (2)";']
