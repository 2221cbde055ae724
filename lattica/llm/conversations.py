"""Least-cost repair of conversations' turn structure by cost layers.

The roles' initials of a repaired conversation spell ``(s?(ua)+)?``. From the last turn to the first, the bits of layer c
say from which grammar states the rest can be repaired at cost c; each further turn shifts and joins the layers of the one
behind it. Costs of different states differ by less than ``LAYERS``, so a turn's layers, counted from its least cost, are
one machine word, for conversations of any length. The first layer that holds the start state is the cost, and following
the bits forward, least letter first, gives the least audit.

Rows reach a task sorted, and a conversation is looked at as its rows pass by. One over ``most_rows`` or ``most_bytes``
is cut into segments at the borders of a range partitioning instead: each segment tells its costs between any two states,
these few numbers are joined from the last segment to the first, and then every segment can be traced on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut

#: States of the grammar, a bit each: nothing yet, a system turn, a user turn, an assistant turn. First and last accept.
START, SYSTEM, USER, ASSISTANT = STATES = (1, 2, 4, 8)
#: Costs of edits; a truncated row that stays costs ``TRUNCATED`` more.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
LAYERS = 16
_WINDOW, _NEVER = (1 << 4 * LAYERS) - 1, 1 << 60
_ALL = {s: sum(s << 4 * c for c in range(LAYERS + 12)) for s in STATES}
#: What follows each state if a role is chosen freely, and where a kept initial leads.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
FOLLOW = {(START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT, (START, "s"): SYSTEM}
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
#: Conversations beyond either go in segments.
MOST_ROWS, MOST_BYTES = 20_000, 8 << 20

Layers = tuple[int, int]  # bits from the least cost on, and that cost


def _into(bits: int, initial: str) -> int:
    """The states from which a turn of this initial leads into those of ``bits``, layer by layer."""
    if initial == "u":
        y = bits & _ALL[USER]
        return y >> 2 | y >> 1 | y << 1
    if initial == "a":
        return (bits & _ALL[ASSISTANT]) >> 1
    return (bits & _ALL[SYSTEM]) >> 1 if initial == "s" else 0


def _chosen(bits: int) -> int:
    return _into(bits, "u") | _into(bits, "a")


def _settled(bits: int, base: int) -> Layers:
    """With insertions in front (more than two are never cheapest), counted from the least cost."""
    for _ in range(2):
        bits |= _chosen(bits) << 4 * INSERT
    low = (bits & -bits).bit_length() - 1 >> 2 if bits else 0
    return bits >> 4 * low & _WINDOW, base + low


ENDED = _settled(START | ASSISTANT, 0)


def cost(layers: Layers, state: int) -> int:
    bits, base = layers
    for c in range(LAYERS):
        if bits >> 4 * c & state:
            return base + c
    return _NEVER


def layers_of(costs: dict[int, int]) -> Layers:
    base = min(costs.values())
    return sum(s << 4 * (c - base) for s, c in costs.items() if c - base < LAYERS), base


@dataclass
class Turn:
    """A row after damage: ``extra`` for a truncated row, ``dead`` for one that must go, ``copies`` of it in a row."""

    role: str
    text: str
    extra: int = 0
    dead: bool = False
    copies: int = 1

    @property
    def initial(self) -> str:
        return self.role[:1] or " "


def before(layers: Layers, turn: Turn) -> Layers:
    """The layers in front of ``turn`` from those behind it."""
    bits, base = layers
    base += DELETE * (turn.copies - 1)
    if turn.dead:
        return bits, base + DELETE
    stays = _into(bits, turn.initial) | _chosen(bits) << 4 * REROLE
    return _settled(bits << 4 * DELETE | stays << 4 * turn.extra, base)


def layer_table(turns: list[Turn], end: Layers) -> list[Layers]:
    table = [end]
    for t in reversed(turns):
        table.append(before(table[-1], t))
    return table[::-1]


def trace(turns: list[Turn], table: list[Layers], state: int, last: bool = True) -> tuple[int, str, list[str]]:
    """Final state, audit and repaired lines of the least audit among the cheapest; ``last``: the conversation ends here."""
    audit, lines, j, left = [], [], 0, cost(table[0], state)
    while j < len(turns) or (last and left):
        t, (to, role) = turns[j] if j < len(turns) else None, NEXT[state]
        more = DELETE * (t.copies - 1) if t else 0
        if t and left == DELETE + more + cost(table[j + 1], state):
            edit, left, j = "D", left - DELETE, j + 1
        elif left == INSERT + cost(table[j], to):
            edit, left, state, more = "I", left - INSERT, to, 0
            lines.append(f"{role}:")
        else:
            kept = FOLLOW.get((state, t.initial))
            if kept and left == t.extra + more + cost(table[j + 1], kept):
                edit, left, state = "K", left - t.extra, kept
                lines.append(f"{t.role}:{t.text}")
            else:
                edit, left, state = "R", left - t.extra - REROLE, to
                lines.append(f"{role}:{t.text}")
            j += 1
        audit.append(edit + "D" * (more // DELETE))
        left -= more
    return state, "".join(audit), lines


# --- what is counted of a conversation ---------------------------------------------------------------------------


@dataclass
class Report:
    """Faults of rows that pass by in order, and the turns that a repair needs."""

    seen: set = field(default_factory=set)
    turns: list[Turn] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    numbers: int = 0
    first: tuple = (None, None)  # least turn number, first initial
    last: tuple = (None, None)

    def add(self, turn: int | None, role: str, text: str, copies: int, known: bool | None = None) -> None:
        """``known``: whether the row was seen earlier, where another segment may have seen it."""
        shown, initial = text.rstrip(SPACE), role[:1] or " "
        if turn is not None and turn != self.last[0]:
            self.numbers += 1
            self.first = (turn if self.first[0] is None else self.first[0], self.first[1])
        self.illegal += (self.last[1] is not None and self.last[1] + initial not in LEGAL) + (copies - 1) * (initial * 2 not in LEGAL)
        self.first, self.last = (self.first[0], self.first[1] or initial), (self.last[0] if turn is None else turn, initial)
        if not shown:
            self.blank += copies
            self.turns.append(Turn(role, text, dead=True, copies=copies))
            return
        if known is None:
            known = (role, text) in self.seen
            self.seen.add((role, text))
        self.duplicate += copies - 1 + known
        cut_off = not known and shown[-1] not in ".!?"
        self.truncated += cut_off
        self.turns.append(Turn(role, text, TRUNCATED * cut_off, known, copies))

    def gaps(self) -> int:
        return self.last[0] - self.first[0] + 1 - self.numbers if self.numbers else 0


OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"
_OUT = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in OUT.split(", ")]


def _result(r: Report, texts: bool) -> tuple:
    table = layer_table(r.turns, ENDED)
    _, audit, lines = trace(r.turns, table, START)
    whole = "\n".join(lines)
    return r.gaps(), r.blank, r.duplicate, r.truncated, r.illegal, cost(table[0], START), audit, hashlib.sha256(whole.encode()).hexdigest(), whole if texts else None


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    names = [("conv_id", pa.int64()), *_OUT]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])


def _grouped(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) of rows that pass by sorted; the rows must be used up before the next group."""

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", *columns)))

    stream = rows()
    held = next(stream, None)

    def group(key):
        nonlocal held
        while held is not None and held[0] == key:
            row, held = held, next(stream, None)
            yield row[1:]

    while held is not None:
        yield held[0], group(held[0])


def _whole(texts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for conv_id, rows in _grouped(batches, ("turn", "role", "text", "copies")):
        r = Report()
        for turn, role, text, copies in rows:
            for _ in range(copies):
                r.add(turn, role, text, 1)
        out.append((conv_id, *_result(r, texts)))
        size += len(out[-1][-1] or "") + len(out[-1][-3])
        if len(out) >= 1000 or size > 1 << 22:
            yield _emit(out)
            out, size = [], 0
    if out:
        yield _emit(out)


# --- conversations in segments -------------------------------------------------------------------------------------

_SEGMENT = ("turn", "role", "text", "copies", "known")
_FACTS = "seg int, gaps_from long, gaps_to long, numbers long, blank long, duplicate long, truncated long, illegal long, head string, tail string, costs array<long>"


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, int, Report]]:
    """A report on each (conversation, partition)."""
    for (conv_id, seg), rows in _keyed(batches):
        r = Report()
        for turn, role, text, copies, known in rows:
            if copies:
                r.add(turn, role, text, copies, known)
        yield conv_id, seg, r


def _keyed(batches):
    tagged = (pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column("conv_id"), b.column("seg")], names=["c", "s"]), *[b.column(c) for c in _SEGMENT]], names=["conv_id", *_SEGMENT]) for b in batches)
    for key, rows in _grouped(tagged, _SEGMENT):
        yield (key["c"], key["s"]), rows


def _costs(turns: list[Turn], to: int) -> list[int]:
    """Costs from each state in front of ``turns`` to state ``to`` behind them, without insertions behind."""
    layers = (to, 0)
    for t in reversed(turns):
        layers = before(layers, t)
    return [cost(layers, s) for s in STATES]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv_id, seg, r in _segments(batches):
        row = {"conv_id": conv_id, "seg": seg, "gaps_from": r.first[0], "gaps_to": r.last[0], "numbers": r.numbers, "blank": r.blank, "duplicate": r.duplicate, "truncated": r.truncated, "illegal": r.illegal, "head": r.first[1], "tail": r.last[1], "costs": [c for s in STATES for c in _costs(r.turns, s)] if r.turns else []}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), *[(c, pa.int64()) for c in ("gaps_from", "gaps_to", "numbers", "blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("tail", pa.string()), ("costs", pa.list_(pa.int64()))]))


def _ends(table: pa.Table) -> pa.Table:
    """For each segment of a conversation the layers behind it, and the conversation's counts in its first row."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
    live = [r for r in rows if r["costs"]]
    ends, after = {}, ENDED
    for r in reversed(live):
        ends[r["seg"]] = after
        from_states = {s: min(r["costs"][4 * k + i] + cost(after, t) for k, t in enumerate(STATES)) for i, s in enumerate(STATES)}
        after = layers_of(from_states)
    known, last = [r for r in live if r["gaps_from"] is not None], None
    numbers = 0
    for r in known:
        numbers += r["numbers"] - (last == r["gaps_from"])
        last = r["gaps_to"]
    illegal = sum(r["illegal"] for r in live) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(live, live[1:]))
    whole = {"gaps": last - known[0]["gaps_from"] + 1 - numbers if known else 0, "illegal": illegal, "cost": cost(after, START) if live else 0, **{k: sum(r[k] for r in live) for k in ("blank", "duplicate", "truncated")}}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for r in rows:
        bits, base = ends.get(r["seg"], (0, 0))
        out.append({"conv_id": r["conv_id"], "seg": r["seg"], "bits": signed(bits), "base": base, "last": bool(live) and r is live[-1], **whole})
    return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("bits", pa.int64()), ("base", pa.int64()), ("last", pa.bool_()), *[(c, pa.int64()) for c in ("gaps", "illegal", "cost", "blank", "duplicate", "truncated")]]))


def _traced(entered: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each state leads through a segment; or, with the state it is ``entered`` in, its audit and repaired lines."""
    ends: dict = {}

    def noted():
        for b in batches:
            for conv_id, seg, *end in set(zip(*(b.column(n).to_pylist() for n in ("conv_id", "seg", "bits", "base", "last", "state")))):
                ends[conv_id, seg] = end
            yield b

    for conv_id, seg, r in _segments(noted()):
        bits, base, last, state = ends.pop((conv_id, seg))
        table = layer_table(r.turns, (bits & _WINDOW, base)) if r.turns else []
        if entered:
            _, audit, lines = trace(r.turns, table, state, last) if r.turns else (state, "", [])
            piece = "\n".join(lines)
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([seg], pa.int32()), pa.array([audit]), pa.array([piece if lines else None], pa.string())], names=["conv_id", "seg", "audit", "piece"])
        else:
            exits = [trace(r.turns, table, s, last)[0] if r.turns and cost(table[0], s) < _NEVER else s for s in STATES]
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([seg], pa.int32()), pa.array([exits], pa.list_(pa.int64()))], names=["conv_id", "seg", "exits"])


def _entered(table: pa.Table) -> pa.Table:
    rows, state = sorted(table.to_pylist(), key=lambda r: r["seg"]), START
    out = []
    for r in rows:
        out.append({"conv_id": r["conv_id"], "seg": r["seg"], "state": state})
        state = r["exits"][STATES.index(state)]
    return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("state", pa.int64())]))


def _assembled(texts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and pieces pass by in order; of a conversation only its audit and the state of its hash are held."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    for conv_id, rows in _grouped(batches, (*counts, "audit", "piece")):
        sha, audit, pieces, found = hashlib.sha256(), [], [], None
        some = False
        for *found, piece_audit, piece in rows:
            audit.append(piece_audit)
            if piece is not None:
                sha.update((("\n" if some else "") + piece).encode())
                some = True
                if texts:
                    pieces.append(piece)
        yield _emit([(conv_id, *found, "".join(audit), sha.hexdigest(), "\n".join(pieces) if texts else None)])


def _in_segments(rows: DataFrame, texts: bool) -> DataFrame:
    key = ("conv_id", "turn", "role", "text")
    segment = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in ("conv_id", "seg")]
    named = lambda d: d.withColumnRenamed("conv_id", "s_conv_id").withColumnRenamed("seg", "s_seg")
    # Equal rows become one with a count, and the first of equal role and text in a conversation is known by its turn.
    one = rows.groupBy(*key).agg(F.sum("copies").alias("copies"))
    first = one.where("copies > 0").groupBy(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "text")]).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    known = F.col("first").isNotNull() & ~(F.col("first.turn").eqNullSafe(F.col("turn")))
    flagged = one.join(first, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("conv_id", "role", "text")], "left").select(*key, "copies", known.alias("known"))
    order = (F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    dealt = cut(flagged.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("seg", F.spark_partition_id())
    ends = cut(dealt.mapInArrow(_facts, f"conv_id long, {_FACTS}").groupBy("conv_id").applyInArrow(_ends, "conv_id long, seg int, bits long, base long, last boolean, gaps long, illegal long, cost long, blank long, duplicate long, truncated long"))

    def with_ends(state: DataFrame) -> DataFrame:
        """The rows in their partitions' order, with what is known of their segment; one small row for each segment."""
        s = F.broadcast(named(state))  # a row for each conversation of a partition, each of thousands of rows or at its border
        return dealt.join(s, segment).select("conv_id", "seg", *_SEGMENT, "bits", "base", "last", "state")

    exits = with_ends(ends.withColumn("state", F.lit(0).cast("long"))).mapInArrow(partial(_traced, False), "conv_id long, seg int, exits array<long>")
    entered = exits.groupBy("conv_id").applyInArrow(_entered, "conv_id long, seg int, state long")
    states = cut(ends.join(named(entered), segment).select(*ends.columns, "state"))
    pieces = with_ends(states).mapInArrow(partial(_traced, True), "conv_id long, seg int, audit string, piece string")
    done = pieces.join(named(states), segment).select("conv_id", "seg", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "piece")
    return done.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(partial(_assembled, texts), f"conv_id long, {OUT}")


def repair(turns: DataFrame, copies: str | None = None, texts: bool = True, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired), a row for each conversation.

    ``turns`` has (conv_id, turn, role, text); other columns are left out. Turns are taken by number, null first, equal
    numbers by role and text. Null roles and texts are one space, null ids are one conversation, and an empty role counts
    as a space where its initial is asked for. A repeated row is a duplicate. ``copies`` names a column that says how often
    a row is there; a row that is there 0 times only names its conversation, and one without rows has zeros, an empty audit
    and the hash of nothing. An empty table stays empty. ``texts`` False leaves ``repaired`` null.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    n = F.lit(1) if copies is None else F.greatest(F.coalesce(F.col(copies).cast("int"), F.lit(0)), F.lit(0))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), n.cast("long").alias("copies"))
    size = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    large = cut(size.where((F.col("n") > most_rows) | (F.col("b") > most_bytes)).select(F.col("conv_id").alias("l")))
    some = not large.isEmpty()
    is_large = rows["conv_id"].eqNullSafe(large["l"])
    small = rows.join(large, is_large, "left_anti") if some else rows
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    done = small.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(partial(_whole, texts), f"conv_id long, {OUT}")
    return done.unionByName(_in_segments(rows.join(large, is_large, "left_semi"), texts)) if some else done


# --- the query -------------------------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with one row in four or so damaged by the CRC-32 of its key, and ``copies`` (0, 1 or 2) of each."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    role = F.when(h == 4, F.lit("user")).otherwise(part("role"))
    text = F.when(h == 1, F.lit("")).when(h == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))


def op13_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(turns), "copies", texts=False).drop("repaired")


#: CRC-32 of an ASCII text, byte by byte and bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))))"""
OP13_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS h
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM raw)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j FROM damaged),
seen AS (SELECT *, CASE role WHEN '' THEN ' ' ELSE left(role, 1) END AS ch, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS unended FROM placed),
turns AS (SELECT conv_id, turn, j, role, text, ch, blank, again AND NOT blank AS duplicate, unended AND NOT again AND NOT blank AS truncated,
  coalesce(lag(ch) OVER (PARTITION BY conv_id ORDER BY j) || ch NOT IN ('su', 'ua', 'au'), FALSE) AS illegal FROM seen),
free(p, f, role) AS (VALUES ('0', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')),
ins(p0, p, cost, audit, lines) AS (
  SELECT p, p, 0, '', []::VARCHAR[] FROM (VALUES ('0'), ('s'), ('u'), ('a')) x(p) UNION ALL SELECT p, f, 3, 'I', [role || ':'] FROM free
  UNION ALL SELECT a.p, b.f, 6, 'II', [a.role || ':', b.role || ':'] FROM free a JOIN free b ON a.f = b.p),
op(p, f, op, ch, role) AS (
  SELECT p, p, 'D', NULL, NULL FROM (VALUES ('0'), ('s'), ('u'), ('a')) x(p) UNION ALL SELECT p, f, 'R', NULL, role FROM free
  UNION ALL SELECT p, f, 'K', left(role, 1), NULL FROM free UNION ALL SELECT '0', 's', 'K', 's', NULL),
v AS (
  SELECT conv_id, n AS j, p0 AS q, arg_min(struct_pack(c := cost, a := audit, l := lines), struct_pack(c := cost, a := audit)) AS best
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), ins WHERE p IN ('0', 'a') GROUP BY conv_id, n, p0
  UNION ALL
  SELECT conv_id, j, q, arg_min(struct_pack(c := c, a := a, l := l), struct_pack(c := c, a := a)) FROM (
    SELECT v.conv_id, v.j - 1 AS j, i.p0 AS q, i.cost + CASE op WHEN 'D' THEN 4 ELSE CASE op WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN truncated THEN 3 ELSE 0 END END + v.best.c AS c,
      i.audit || op || v.best.a AS a, i.lines || CASE op WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [o.role || ':' || t.text] END || v.best.l AS l
    FROM v JOIN turns t ON t.conv_id IS NOT DISTINCT FROM v.conv_id AND t.j = v.j JOIN op o ON o.f = v.q JOIN ins i ON i.p = o.p
    WHERE (op = 'D' OR NOT (blank OR duplicate)) AND (o.ch IS NULL OR o.ch = t.ch)) GROUP BY conv_id, j, q),
report AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v.best.c, 0)::BIGINT AS cost, coalesce(v.best.a, '') AS audit, sha256(coalesce(array_to_string(v.best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN report r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.j = 0 AND v.q = '0'
""".replace("CRC", _CRC.format(key="k"))
