"""Instructions to points-to statements: one projection per opcode.

``facts`` are the tables of ``sources.facts``. Statements carry their method ``m``. Values that are primitive
(``value_type`` has a negative type) or null constants take no part in points-to sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.operators.fixpoint import closure, counted, grow, settle, union_all

#: Exceptions that the virtual machine raises, by opcode.
IMPLICIT = (
    ("ARRAY_LENGTH", "NullPointerException"), ("GET_FIELD", "NullPointerException"), ("PUT_FIELD", "NullPointerException"), ("MONITOR", "NullPointerException"), ("THROW", "NullPointerException"),
    ("INVOKE_VIRTUAL", "NullPointerException"), ("INVOKE_SPECIAL", "NullPointerException"), ("INVOKE_INTERFACE", "NullPointerException"), ("CHECK_CAST", "ClassCastException"),
    ("LOAD_METADATA", "ClassNotFoundException"), ("NEW_ARRAY", "NegativeArraySizeException"), ("ARRAY_LOAD", "NullPointerException"), ("ARRAY_LOAD", "ArrayIndexOutOfBoundsException"),
    ("ARRAY_STORE", "NullPointerException"), ("ARRAY_STORE", "ArrayIndexOutOfBoundsException"), ("ARRAY_STORE", "ArrayStoreException"), ("BINARY_OP_EX", "ArithmeticException"),
)


def implicit_table(like: DataFrame) -> DataFrame:
    """(op, type_name), a table of fixed size."""
    return F.broadcast(like.sparkSession.createDataFrame(list(IMPLICIT), "op string, type_name string"))


def _u(i: int):
    return F.get("uses", F.lit(i))


def _references(df: DataFrame, skip: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose ``columns`` is in ``skip`` (m, v)."""
    for c in columns:
        s = skip.select(F.col("m").alias("__m"), F.col("v").alias("__v"))
        df = df.join(s, (df["m"] == s["__m"]) & (df[c] == s["__v"]), "left_anti")
    return df


def statements(instr: DataFrame, primitive: DataFrame, null_const: DataFrame) -> dict[str, DataFrame]:
    """Statement tables from ``instr``; ``primitive`` and ``null_const`` are (m, v)."""
    op = lambda *names: instr.where(F.col("op").isin(*names))
    skip = primitive.select("m", "v").union(null_const.select("m", "v")).distinct()
    out = {
        "aload": _references(op("ARRAY_LOAD").select("m", F.col("def").alias("dst"), _u(0).alias("base")), primitive, "dst"),
        "astore": _references(op("ARRAY_STORE").select("m", _u(0).alias("base"), _u(1).alias("src")), skip, "src"),
        "cast": _references(op("CHECK_CAST").select("m", F.col("def").alias("dst"), _u(0).alias("src"), F.col("type_ref").alias("type")), null_const, "src"),
        "load": _references(op("GET_FIELD").select("m", F.col("def").alias("dst"), _u(0).alias("base"), F.col("field_ref").alias("f")), primitive, "dst"),
        "sload": _references(op("GET_STATIC").select("m", F.col("def").alias("dst"), F.col("field_ref").alias("f")), primitive, "dst"),
        "store": _references(op("PUT_FIELD").select("m", _u(0).alias("base"), F.col("field_ref").alias("f"), _u(1).alias("src")), skip, "src"),
        "sstore": _references(op("PUT_STATIC").select("m", F.col("field_ref").alias("f"), _u(0).alias("src")), skip, "src"),
        "new": op("NEW_OBJECT", "NEW_ARRAY").select("m", F.col("def").alias("v"), "site", F.col("type_ref").alias("type")),
        "phi": _references(op("PHI").select("m", F.col("def").alias("dst"), F.explode("uses").alias("src")), skip, "src").distinct(),
        "metadata": op("LOAD_METADATA").select("m", F.col("def").alias("dst"), F.col("type_ref").alias("type")),
        "ret": _references(op("RETURN").where(_u(0).isNotNull()).select("m", _u(0).alias("src")), skip, "src"),
        "thrown": op("THROW").select("m", "bb", "iid", _u(0).alias("src")),
    }
    calls = op("INVOKE_STATIC", "INVOKE_SPECIAL", "INVOKE_VIRTUAL", "INVOKE_INTERFACE").withColumn("receiver", F.when(F.col("op") != "INVOKE_STATIC", _u(0)))
    virtual = F.col("op").isin("INVOKE_VIRTUAL", "INVOKE_INTERFACE")
    lost = calls.where(virtual).join(null_const.select("m", F.col("v").alias("receiver")), ["m", "receiver"], "left_semi").select("iid")
    kind = F.when(F.col("op") == "INVOKE_STATIC", "static").when(F.col("op") == "INVOKE_SPECIAL", "special").otherwise("virtual")
    out["call"] = calls.join(lost, "iid", "left_anti").select("m", "iid", "site", "target", kind.alias("dispatch"), "receiver", F.col("def").alias("result"), "uses")
    return out


def actuals(call: DataFrame, skip: DataFrame) -> DataFrame:
    """(m, site, i, v): arguments of calls; primitives and nulls (``skip``) are left out, positions stay."""
    return _references(call.select("m", "site", F.posexplode("uses").alias("i", "v")), skip, "v")


def inner_arrays(new_array: DataFrame) -> DataFrame:
    """(site, level, outer, inner) for arrays of ``dims`` dimensions: each level is stored in the one around it."""
    levels = F.when(F.col("dims") > 1, F.sequence(F.lit(1), F.col("dims") - 1)).otherwise(F.array().cast("array<int>"))
    return new_array.select("site", F.explode(levels).alias("level")).select("site", "level", (F.col("level") - 1).alias("outer"), F.col("level").alias("inner"))


def single_sites(new: DataFrame, merged: DataFrame) -> DataFrame:
    """``new`` with allocations of the types in ``merged`` (type) sharing one site a type, numbered below zero."""
    m = merged.select("type", F.lit(True).alias("__one")).distinct()
    return new.join(m, "type", "left").withColumn("site", F.when(F.col("__one"), -F.col("type") - 1).otherwise(F.col("site"))).drop("__one")


def string_literals(const: DataFrame, instr: DataFrame) -> DataFrame:
    """(m, v, sval): every string literal that an instruction uses, once."""
    used = instr.select("m", F.explode("uses").alias("v")).distinct()
    return const.where("kind = 'str'").select("m", "v", "sval").join(used, ["m", "v"], "left_semi").distinct()


def generated_exceptions(instr: DataFrame) -> DataFrame:
    """(m, bb, iid, type_name): exceptions that the virtual machine may raise at each instruction."""
    return instr.join(implicit_table(instr), "op").select("m", "bb", "iid", "type_name")


def catch_routing(thrown: DataFrame, cfg_edge: DataFrame, catch_type: DataFrame, subtype: DataFrame, compat: bool = False) -> DataFrame:
    """Exception assignments (m, iid, bb, dst, type, not_types, caught) of ``thrown`` (m, bb, iid, type).

    Handlers count in their order. One that surely catches the type ends the walk; one that may catch it gets the
    handlers before it as ``not_types``. The rest goes to the exit (dst null) unless surely caught. With ``compat`` a
    sure catch does not end the walk and is not excluded later.
    """
    succ = cfg_edge.where("kind = 'E'").select("m", F.col("src").alias("bb"), F.col("dst"))
    handlers = catch_type.select("m", F.col("bb").alias("dst"), F.col("ord"), F.col("type").alias("caught"))
    walk = thrown.join(succ, ["m", "bb"]).join(handlers, ["m", "dst"])
    up = subtype.select(F.col("sup").alias("caught"), F.col("sub").alias("type"), F.lit(True).alias("sure"))
    down = subtype.select(F.col("sub").alias("caught"), F.col("sup").alias("type"), F.lit(True).alias("maybe"))
    walk = walk.join(up, ["caught", "type"], "left").join(down, ["caught", "type"], "left").where("sure or maybe").fillna(False, ["sure", "maybe"])
    before = W.partitionBy("m", "iid", "type").orderBy("dst", "ord").rowsBetween(W.unboundedPreceding, -1)
    seen = F.sort_array(F.array_distinct(F.collect_list(F.when(~F.col("sure") if compat else F.lit(True), F.col("caught"))).over(before)))
    ended = F.coalesce(F.bool_or("sure").over(before), F.lit(False))
    walk = walk.withColumn("not_types", seen).withColumn("ended", ended)
    hits = (walk if compat else walk.where("not ended")).select("m", "iid", "bb", "dst", "type", "not_types", "caught")
    sure = walk.where("sure").select("m", "iid", "type").distinct()
    nots = walk.groupBy("m", "iid", "type").agg(F.sort_array(F.collect_set("caught")).alias("nots"))
    rest = (thrown if compat else thrown.join(sure, ["m", "iid", "type"], "left_anti")).join(nots, ["m", "iid", "type"], "left")
    out = rest.select("m", "iid", "bb", F.lit(None).cast("long").alias("dst"), "type", F.coalesce("nots", F.array().cast("array<long>")).alias("not_types"), F.lit(None).cast("long").alias("caught"))
    return hits.unionByName(out)


def class_inits(trigger: DataFrame, instr: DataFrame, klass: DataFrame, method: DataFrame) -> DataFrame:
    """(m, clinit): initialisers that instructions may run, of the class and its superclasses, not of interfaces."""
    ups = closure(klass.where("super is not null").select(F.col("t").alias("src"), F.col("super").alias("dst")), klass.select(F.col("t").alias("node"), F.col("t").alias("item")))
    chain = ups.select(F.col("item").alias("t"), F.col("node").alias("up")).join(klass.where("not is_interface").select(F.col("t").alias("up")), "up")
    found = trigger.join(chain, "t").join(instr.select("iid", "m"), "iid")
    return found.join(method.where("is_clinit").select(F.col("m").alias("clinit"), F.col("declaring").alias("up")), "up").select("m", "clinit").distinct()


def native_defaults(method: DataFrame, declared: DataFrame) -> DataFrame:
    """(m, kind, type): what native methods without a model allocate: their result, declared exceptions, RuntimeException."""
    native = method.where("is_native")
    ret = native.where("ret_type >= 0").select("m", F.lit("RET").alias("kind"), F.col("ret_type").cast("string").alias("type"))
    thrown = native.join(declared, "m").select("m", F.lit("EX").alias("kind"), F.col("type").cast("string").alias("type"))
    return union_all([ret, thrown, native.select("m", F.lit("EX").alias("kind"), F.lit("RuntimeException").alias("type"))])


def formal_copies(param: DataFrame, skip: DataFrame) -> DataFrame:
    """(m, i, dst): formal i of a method is copied to its local."""
    return _references(param.select("m", "i", F.col("v").alias("dst")), skip, "dst")


def discover(entry: DataFrame, call: DataFrame, alloc: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Methods to register and classes instantiated: virtual targets wait until their class has an instance.

    ``call`` is (m, dispatch, target, selector), ``alloc`` (m, t), ``targets`` (t, selector, callee).
    """
    direct = settle(call.where("dispatch <> 'virtual'").select("m", F.col("target").alias("callee")).distinct())
    virtual = settle(call.where("dispatch = 'virtual'").select("m", "selector").join(targets, "selector").select("m", "t", "callee").distinct())
    alloc = settle(alloc.select("m", "t").distinct())

    def step(d, t):
        pairs = [(r, i) for r, i in ((d.get("reach"), t["inst"]), (t["reach"], d.get("inst"))) if r is not None and i is not None]
        waiting = [r.join(virtual, "m").join(i, "t").select(F.col("callee").alias("m")) for r, i in pairs]
        if "reach" not in d:
            return {"reach": waiting}
        return {"reach": [d["reach"].join(direct, "m").select(F.col("callee").alias("m")), *waiting], "inst": [d["reach"].join(alloc, "m").select("t")]}

    found = grow({"reach": entry.select("m"), "inst": alloc.select("t").limit(0)}, step, sparse=True)
    return found["reach"], found["inst"]


def singletons(new: DataFrame) -> DataFrame:
    """(type, v, site): one variable and one allocation for each type that shares its allocations."""
    return new.where("site < 0").select("type", (-F.col("type") - 1).alias("v"), "site").distinct()


def unduplicate(stmts: DataFrame, most_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """Statements (m, kind, key array<long>, def) without repeats, and (m, v, rep) for values that became another.

    Statements of one method, kind and key have one value: the smallest definition stands for all. ``key`` is rewritten
    until nothing changes. Phis are sorted by key first, so their order does not matter.
    """
    index = None
    for _ in range(most_rounds):
        key = F.when(F.col("kind") == "phi", F.sort_array(F.array_distinct("key"))).otherwise(F.col("key"))
        s = settle(stmts.withColumn("key", key).distinct())
        rep = F.min("def").over(W.partitionBy("m", "kind", "key"))
        moved, n = counted(s.withColumn("rep", rep).where("def <> rep").select("m", F.col("def").alias("v"), "rep").distinct())
        if not n:
            return s, index if index is not None else moved
        moved = settle(closure_rep(moved))
        index = moved if index is None else closure_rep(index.unionByName(moved))
        stmts = _renamed(s, moved)
    raise RuntimeError("duplicates did not settle")


def closure_rep(moved: DataFrame) -> DataFrame:
    """(m, v, rep) followed to the last representative."""
    nxt = moved.select("m", F.col("v").alias("rep"), F.col("rep").alias("far"))
    out = moved
    while True:
        far = out.join(nxt, ["m", "rep"], "left")
        if far.where("far is not null").isEmpty():
            return out.distinct()
        out = far.select("m", "v", F.coalesce("far", "rep").alias("rep"))


def _renamed(stmts: DataFrame, moved: DataFrame) -> DataFrame:
    """Statements after their values' renaming. A statement is known by its columns: a number given to rows where they come
    to lie may differ when they are read a second time."""
    row = ["m", "kind", "key", "def"]
    parts = stmts.select(*row, F.posexplode_outer("key").alias("i", "v")).join(moved, ["m", "v"], "left")
    new = F.transform(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", F.coalesce("rep", "v").alias("v"))))), lambda x: x["v"])
    d = parts.groupBy(*row).agg(new.alias("new_key")).join(moved.withColumnRenamed("v", "def"), ["m", "def"], "left")
    return d.select("m", "kind", F.when(F.col("key").isNotNull(), F.col("new_key")).alias("key"), F.coalesce("rep", "def").alias("def")).distinct()
