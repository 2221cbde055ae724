"""Program facts as tables: schemas, loading, substitution of models, and encodings of general tables as programs.

``ENCODINGS`` are SQL texts that Spark and DuckDB read alike; they turn the benchmark tables into program facts, so every
analysis can run, and be checked, on data of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.fixpoint import honest_sizes

#: Columns and types of the fact tables.
SCHEMAS = {
    "klass": "t long, name string, super long, is_interface boolean, is_array boolean, elem long",
    "implements": "t long, iface long",
    "method": "m long, name string, selector string, declaring long, is_static boolean, is_native boolean, is_abstract boolean, is_init boolean, is_clinit boolean, ret_type long",
    "field": "f long, declaring long, name string, type long, is_static boolean, is_final boolean",
    "block": "m long, bb long, is_entry boolean, is_exit boolean, is_catch boolean",
    "cfg_edge": "m long, src long, dst long, kind string",
    "catch_type": "m long, bb long, ord int, type long",
    "instr": "m long, bb long, idx int, iid long, op string, def long, uses array<long>, exc long, type_ref long, field_ref long, target long, site long, pc int, line int",
    "const": "m long, v long, kind string, sval string, dval double",
    "value_type": "m long, v long, type long",
    "param": "m long, i int, v long",
    "call_site": "site long, m long, iid long, target long, dispatch string, actuals array<long>, result long, exc long",
    "clinit_trigger": "iid long, t long",
    "entry": "m long",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def load(spark: SparkSession, folder: str, names: list[str] | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Fact tables from ``folder``/<name>, Parquet, JSON, ORC or CSV, under their declared types."""
    out = {}
    for name in names or list(SCHEMAS):
        reader = spark.read.format(fmt).schema(SCHEMAS[name])
        out[name] = reader.load(f"{folder}/{name}.{fmt}")
    return out


def frames(spark: SparkSession, rows: dict[str, list[tuple]]) -> dict[str, DataFrame]:
    """Literal facts, for programs small enough to write down."""
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}


def with_root(method: DataFrame, call_site: DataFrame, mains: DataFrame, root: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A synthetic root method that calls every method of ``mains`` (m): (method, call_site, entry)."""
    spark = method.sparkSession
    made = spark.createDataFrame([(root, "fakeRoot", "fakeRoot()", None, True, False, False, False, False, None)], SCHEMAS["method"])
    calls = mains.select((-F.col("m") - 1).alias("site"), F.lit(root).cast("long").alias("m"), (-F.col("m") - 1).alias("iid"), F.col("m").alias("target"), F.lit("static").alias("dispatch"), F.array().cast("array<long>").alias("actuals"), F.lit(None).cast("long").alias("result"), F.lit(None).cast("long").alias("exc"))
    return method.unionByName(made), call_site.unionByName(calls), spark.createDataFrame([(root,)], SCHEMAS["entry"])


def substitute(real: DataFrame, model: DataFrame) -> DataFrame:
    """Instructions with modelled methods' bodies in place of their real ones."""
    return real.join(model.select("m").distinct(), "m", "left_anti").unionByName(model)


def def_use(instr: DataFrame) -> DataFrame:
    """(m, v, def_iid, use_iid): the instruction that defines each value and those that use it; null where there is none."""
    defs = instr.where("def is not null").select("m", F.col("def").alias("v"), F.col("iid").alias("def_iid"))
    uses = instr.select("m", F.explode("uses").alias("v"), F.col("iid").alias("use_iid")).distinct()
    return defs.join(uses, ["m", "v"], "full_outer")


def resolve_models(method: DataFrame, klass: DataFrame, models: DataFrame, prefix: str = "signatures/library/") -> DataFrame:
    """(m, model): the model of each method. ``models`` has (model, owner, name, ret, args); the first of name and
    arguments and return type, name and return type, name and arguments, name alone that fits is taken."""
    named = method.join(klass.select(F.col("t").alias("declaring"), F.concat(F.lit(prefix), "name").alias("owner")), "declaring")
    named = named.select("m", "owner", "name", F.regexp_extract("selector", r"\((.*)\)", 1).alias("args"), F.col("ret_type").cast("string").alias("ret"))
    m = models.select("model", *[F.col(c).alias(f"x_{c}") for c in ("owner", "name", "ret", "args")])
    hit = named.join(m, (F.col("owner") == F.col("x_owner")) & (F.col("name") == F.col("x_name")))
    rank = F.when(F.col("args") == F.col("x_args"), 2).otherwise(0) + F.when(F.col("ret") == F.col("x_ret"), 1).otherwise(0)
    return hit.groupBy("m").agg(F.max_by("model", F.struct(rank, -F.col("model"))).alias("model"))


def rewrite_types(instr: DataFrame, type_map: DataFrame, columns: tuple[str, ...] = ("type_ref",)) -> DataFrame:
    """Model types in ``columns`` replaced by the real ones of ``type_map`` (model, real)."""
    for c in columns:
        found = type_map.select(F.col("model").alias("__model"), F.col("real").alias("__real"))
        instr = instr.join(found, F.col(c) == F.col("__model"), "left").withColumn(c, F.coalesce("__real", c)).drop("__model", "__real")
    return instr


#: Immutable wrapper classes; the last two only while nothing extends them.
WRAPPERS = ("Ljava/lang/String", "Ljava/lang/Integer", "Ljava/lang/Boolean", "Ljava/lang/Long", "Ljava/lang/Character", "Ljava/lang/Byte", "Ljava/lang/Double", "Ljava/lang/Float", "Ljava/lang/Short")
OPEN_WRAPPERS = ("Ljava/math/BigDecimal", "Ljava/math/BigInteger")


def immutable_wrappers(klass: DataFrame, subtype: DataFrame) -> DataFrame:
    """Types (t) whose objects never change and may share one allocation."""
    alone = subtype.groupBy("sup").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("sup").alias("t"))
    return klass.where(F.col("name").isin(*WRAPPERS)).select("t").union(klass.where(F.col("name").isin(*OPEN_WRAPPERS)).select("t").join(alone, "t", "left_semi"))


# --- encodings of general tables as programs -------------------------------------------------------------------

OPS = (
    "ARRAY_LENGTH", "ARRAY_LOAD", "ARRAY_STORE", "BINARY_OP", "BINARY_OP_EX", "CHECK_CAST", "COMPARISON", "CONDITIONAL_BRANCH", "CONVERSION", "GET_CAUGHT_EXCEPTION", "GET_FIELD", "GET_STATIC", "GOTO",
    "INSTANCE_OF", "INVOKE_INTERFACE", "INVOKE_SPECIAL", "INVOKE_STATIC", "INVOKE_VIRTUAL", "LOAD_METADATA", "MONITOR", "NEW_ARRAY", "NEW_OBJECT", "PHI", "PUT_FIELD", "PUT_STATIC", "RETURN", "SWITCH", "THROW", "UNARY_NEG_OP",
)
_OP_CASE = "CASE event_id % 29 " + " ".join(f"WHEN {i} THEN '{op}'" for i, op in enumerate(OPS)) + " END"

ENCODINGS: dict[str, str] = {
    # a tree of types: one root, regions, nations, and a nation's market segments
    "klass": """
        SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS super, 'Object' AS name
        UNION ALL SELECT CAST(1 + r_regionkey AS BIGINT), CAST(0 AS BIGINT), r_name FROM region
        UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), n_name FROM nation
        UNION ALL SELECT DISTINCT CAST(1000 + 100 * c_nationkey + length(c_mktsegment) AS BIGINT), CAST(100 + c_nationkey AS BIGINT), c_mktsegment FROM customer""",
    # allocations and copies
    "new": "SELECT l_partkey AS v, l_suppkey AS heap FROM lineitem WHERE l_linenumber = 1",
    "assign": "SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM part WHERE p_partkey >= 2",
    "cyclic": "SELECT p_partkey AS src, p_partkey - p_partkey % 60 + (p_partkey * 7 + 3) % 60 AS dst FROM part",
    # field statements: every order is a variable with an object of its own, and a statement by its status: a copy, two
    # stores into different fields, or a load
    "new_order": "SELECT o_orderkey AS v, o_orderkey AS heap FROM orders",
    "copy_order": "SELECT o_orderkey AS src, o_orderkey - 1 AS dst FROM orders WHERE o_orderstatus = 'P' AND o_orderkey > 0",
    "store": """
        SELECT o_orderkey AS base, CAST(length(o_orderpriority) AS BIGINT) AS f, o_orderkey - 1 AS src FROM orders WHERE o_orderstatus = 'O'
        UNION ALL SELECT o_orderkey, CAST(length(o_orderpriority) + 1 AS BIGINT), o_orderkey + 1 FROM orders WHERE o_orderstatus = 'O'""",
    "load": "SELECT o_orderkey AS dst, o_orderkey - 1 AS base, CAST(length(o_orderpriority) + o_custkey % 2 AS BIGINT) AS f FROM orders WHERE o_orderstatus = 'F'",
    # methods, blocks and instructions: one method a user, one block an event
    "ev": "SELECT event_id, user_id AS m, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bb, count(*) OVER (PARTITION BY user_id) AS n_blocks FROM events",
    "instr": f"""
        SELECT m, CAST(bb AS BIGINT) AS bb, event_id AS iid, {_OP_CASE} AS op, event_id AS def, event_id % 211 AS u0, event_id % 199 AS u1, event_id % 17 AS type_ref, event_id % 13 AS field_ref,
               CAST(event_id AS BIGINT) AS site, event_id % 25 AS target, value FROM ev""",
    "cfg_edge": """
        SELECT m, CAST(bb AS BIGINT) AS src, CAST(bb + 1 AS BIGINT) AS dst, 'N' AS kind FROM ev WHERE bb + 1 < n_blocks
        UNION ALL SELECT m, CAST(bb AS BIGINT), CAST(n_blocks AS BIGINT), 'E' FROM ev WHERE event_type = 'error'
        UNION ALL SELECT m, CAST(bb AS BIGINT), CAST(floor(bb / 2) AS BIGINT), 'N' FROM ev WHERE event_type = 'view' AND bb > 0""",
    # the same instructions with flow that ends in an exit block: branches, loops, switches, handlers and returns; and calls
    "flow": f"""
        SELECT m, CAST(bb AS BIGINT) AS src, CAST(CASE WHEN op = 'RETURN' THEN n_blocks ELSE bb + 1 END AS BIGINT) AS dst, 'N' AS kind, CASE WHEN op = 'CONDITIONAL_BRANCH' THEN 'F' END AS branch
        FROM (SELECT *, {_OP_CASE} AS op FROM ev) o WHERE op <> 'THROW'
        UNION ALL SELECT m, CAST(bb AS BIGINT), CAST(CASE WHEN event_type = 'view' THEN floor(bb / 2) ELSE least(bb + 2, n_blocks) END AS BIGINT), 'N', CASE WHEN op = 'CONDITIONAL_BRANCH' THEN 'T' END
        FROM (SELECT *, {_OP_CASE} AS op FROM ev) o WHERE op IN ('CONDITIONAL_BRANCH', 'SWITCH')
        UNION ALL SELECT m, CAST(bb AS BIGINT), CAST(CASE WHEN event_type = 'error' THEN n_blocks ELSE least(bb + 3, n_blocks) END AS BIGINT), 'E', NULL
        FROM (SELECT *, {_OP_CASE} AS op FROM ev) o WHERE op IN ('CHECK_CAST', 'THROW') OR op LIKE 'INVOKE%'""",
    "exit_block": "SELECT DISTINCT m, CAST(n_blocks AS BIGINT) AS bb FROM ev",
    "target": """
        SELECT e.event_id AS site, t.user_id AS callee FROM events e JOIN events t ON t.event_id = e.event_id - 1 - e.event_id % 50 WHERE e.event_id % 4 <> 0
        UNION SELECT e.event_id, t.user_id FROM events e JOIN events t ON t.event_id = e.event_id - 2 - e.event_id % 90 WHERE e.event_id % 29 IN (14, 17)""",
    "nullc": "SELECT DISTINCT m, event_id % 199 AS v FROM ev WHERE event_id % 11 = 0",
    "prim": "SELECT DISTINCT m, event_id AS v FROM ev WHERE event_id % 7 = 0",
    # one method an order: a tree of calls, and some calls back
    "meth": "SELECT o_orderkey AS m FROM orders",
    "call": """
        SELECT CAST(floor(o_orderkey / 8) AS BIGINT) AS caller, o_orderkey AS callee FROM orders WHERE o_orderkey > 0
        UNION SELECT o_orderkey, CAST(floor(o_orderkey / 8) AS BIGINT) FROM orders WHERE o_orderkey % 500 = 7""",
    "local_access": "SELECT DISTINCT o_orderkey AS m, o_custkey AS loc FROM orders",
    "iv": "SELECT event_id AS iid, CAST(value AS DOUBLE) / 40 - 2 AS x, CAST(event_id % 9 AS DOUBLE) - 4 AS y FROM events",
}


def encoded(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named encodings over the tables in ``sf_dir``."""
    honest_sizes(spark)
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    spark.sql(ENCODINGS["ev"]).createOrReplaceTempView("ev")
    return {n: spark.sql(ENCODINGS[n]) for n in names}


def oracle(*names: str) -> str:
    """The same encodings as the head of a DuckDB query."""
    order = dict.fromkeys(n for n in ("ev", *names) if n != "ev" or any("ev" in ENCODINGS[x].split() for x in names))
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({ENCODINGS[n].replace('floor(p_partkey / 2)', 'p_partkey // 2').replace('floor(bb / 2)', 'bb // 2').replace('floor(o_orderkey / 8)', 'o_orderkey // 8')})" for n in order)
