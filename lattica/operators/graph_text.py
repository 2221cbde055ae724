"""Graphs as text: ordered lines, which are written as the parts of one file and never pass one task.

Lines are rows (place, line); ``place`` is a struct that orders them. What is written depends on the rows alone, not on how
they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.text import dot_escape
from lattica.operators.fixpoint import settle, union_all
from lattica.operators.pdg import node_id

HEAD = ("digraph G {", "nodesep=%s;", "ranksep=%s;", "graph [fontsize=10];", "node [fontsize=10];", "edge [fontsize=10];")
#: Objects whose names hold one of these have no edges in the text of points-to sets.
SUPPRESSED = ("Exception", "CaseInsensitiveComparator", "allocated at void com.ibm.wala.FakeRootClass.fakeRootMethod", "ObjectStreamField")


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with ``label``: the name, and from its second row on by ``order`` its number in brackets.

    Rows are ranged by name and order; a name that spans many ranges is numbered in each and moved by the counts of the
    ranges before, so no name has to fit one task.
    """
    part = settle(rows.repartitionByRange(name, *order).withColumn("__part", F.spark_partition_id()))
    before = part.groupBy(name, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = before.withColumn("__n", F.coalesce(F.sum("__n").over(W.partitionBy(name).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(W.partitionBy(name, "__part").orderBy(*order)) - 1
    nth = F.col("__n") + F.col("__at")
    label = F.when(nth == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), nth, F.lit(")")))
    return part.withColumn("__at", at).join(before, [name, "__part"]).withColumn("label", label).drop("__part", "__n", "__at")


def _place(part: int, m: Column | None = None, step: int = 0, a: Column | None = None, b: Column | None = None) -> Column:
    text = lambda x: F.coalesce(x.cast("string"), F.lit("")) if x is not None else F.lit("")
    return F.struct(F.lit(part).alias("part"), (m if m is not None else F.lit(0)).cast("long").alias("m"), F.lit(step).alias("step"), text(a).alias("a"), text(b).alias("b")).alias("place")


def _fixed(like: DataFrame, part: int, lines: tuple[str, ...]) -> DataFrame:
    rows = like.sparkSession.createDataFrame(list(enumerate(lines)), "m long, line string")
    return rows.select(_place(part, F.col("m")), "line")


def write_lines(lines: DataFrame, folder: str, gzip: bool = True, parts: int | None = None) -> None:
    """Lines in order into the text parts of ``folder``; the parts one after the other are the file."""
    by = [F.col("place")] if parts is None else [parts, F.col("place")]
    lines.repartitionByRange(*by).sortWithinPartitions("place").select("line").write.text(folder, compression="gzip" if gzip else "none")


def graph_dot(nodes: DataFrame, edges: DataFrame, spread: float = 1.0, methods: DataFrame | None = None) -> DataFrame:
    """Lines of nodes (id, m, key, name, filled) in clusters of their m, then of edges. With ``methods`` (m) only edges
    that touch those methods, and their nodes."""
    if methods is not None:
        edges = edges.join(methods.select(F.col("m").alias("sm")), "sm", "left_semi").unionByName(edges.join(methods.select(F.col("m").alias("dm")), "dm", "left_semi")).distinct()
        ends = edges.select(F.col("sm").alias("m"), F.col("src").alias("key")).union(edges.select("dm", "dst")).distinct()
        nodes = nodes.join(ends, ["m", "key"], "left_semi")
    clean = F.replace(F.replace(F.replace(F.replace(F.col("name"), F.lit('"'), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("(newline)")), F.lit("\t"), F.lit("(tab)"))
    shown = settle(numbered(nodes.withColumn("name", clean), "name", "m", "key"))
    m = F.col("m")
    style = F.when(F.col("filled"), F.lit("[style=filled, fillcolor=gray95]")).otherwise(F.lit(""))
    group = shown.select("m").distinct()
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x]).alias("line")
    ends = edges.join(shown.select(F.col("m").alias("sm"), F.col("key").alias("src"), F.col("label").alias("s")), ["sm", "src"]).join(shown.select(F.col("m").alias("dm"), F.col("key").alias("dst"), F.col("label").alias("d")), ["dm", "dst"])
    mark = F.concat("type", F.coalesce(F.concat(F.lit(" "), "label_type", F.lit("-"), "label_id"), F.lit("")))
    text = line('\t"', F.col("s"), '" -> "', F.col("d"), '" [label="', mark, '"];')
    return union_all([
        _fixed(nodes, 0, tuple(h.replace("%s", str(spread)) for h in HEAD)), group.select(_place(1, m), line('\tsubgraph "cluster_m', m, '"{')), group.select(_place(1, m, 1), line('\tlabel="m', m, '";')),
        shown.select(_place(1, m, 2, F.col("label")), line('\t\t"', F.col("label"), '" ', style)), group.select(_place(1, m, 3), line("\t}")),
        ends.select(_place(2, F.col("sm"), 0, F.col("s"), F.concat_ws("\t", "d", mark)), text), _fixed(nodes, 3, ("}",)),
    ])


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of one object: nodes (id, m, key, type, name), then edges between their ids. A row a line, and a comma before
    all but the first; the names of the two lists stand without quotes, as readers of such files expect."""
    n = nodes.select(F.col("id").alias("k"), F.to_json(F.struct(F.lit("EXPR").alias("class"), F.lit(None).cast("string").alias("position"), F.col("id").cast("string").alias("nodeid"), "name", "type", F.concat(F.lit("m"), "m").alias("group"), F.lit(False).alias("isShortCircuit")), {"ignoreNullFields": "false"}).alias("j"))
    label = F.when(F.col("label_type").isNotNull(), F.struct(F.col("label_type").alias("type"), F.col("label_id").alias("id"), "receivers"))
    e = edges.select(F.to_json(F.struct(node_id(F.col("sm"), F.col("src")).cast("string").alias("source"), node_id(F.col("dm"), F.col("dst")).cast("string").alias("dest"), "type", label.alias("label"))).alias("j"))

    def listed(d: DataFrame, part: int) -> DataFrame:
        d = d.distinct()
        first = d.agg(F.min("j").alias("j")).withColumn("first", F.lit(True))
        return d.join(F.broadcast(first), "j", "left").select(_place(part, None, 0, F.when(F.col("first"), F.lit("")).otherwise(F.col("j"))), F.when(F.col("first"), F.col("j")).otherwise(F.concat(F.lit(", "), "j")).alias("line"))

    return union_all([_fixed(nodes, 0, ("{ nodes:[",)), listed(n.select("j"), 1), _fixed(nodes, 2, ("],", "  edges:[")), listed(e, 3), _fixed(nodes, 4, ("]", "}"))])


def points_to_dot(pts: DataFrame, names: DataFrame, heaps: DataFrame, spread: float = 1.0) -> DataFrame:
    """Lines of the points-to relation (v, heap) with names (v, name) and heaps (heap, name); variables are numbered
    before objects of the same name."""
    both = names.select(F.lit(0).alias("kind"), F.col("v").alias("of"), dot_escape(F.col("name")).alias("name")).unionByName(heaps.select(F.lit(1).alias("kind"), F.col("heap").alias("of"), dot_escape(F.col("name")).alias("name")))
    shown = settle(numbered(both, "name", "kind", "of"))
    hidden = F.lit(False)
    for x in SUPPRESSED:
        hidden = hidden | F.contains(F.col("label"), F.lit(x))
    to = shown.where(F.col("kind") == 1).where(~hidden).select(F.col("of").alias("heap"), F.col("label").alias("d"))
    e = pts.distinct().join(to, "heap").join(shown.where("kind = 0").select(F.col("of").alias("v"), F.col("label").alias("s")), "v")
    text = e.select(_place(1, None, 0, F.col("s"), F.col("d")), F.concat(F.lit('\t"'), "s", F.lit('" -> "'), "d", F.lit('";')).alias("line"))
    return union_all([_fixed(pts, 0, tuple(h.replace("%s", str(spread)) for h in HEAD)), text, _fixed(pts, 2, ("}",))])
