"""Runs of words that repeat with a period, found by an all-lag vectorised scan.

A text is an array of word ids. For every lag p up to n / ``MIN_EXPONENT`` the array is compared with itself shifted by p;
a true stretch of t positions is a stretch of t + p words with period p. Texts are scanned together: their arrays lie
behind each other, shortest first, and no two texts share an id, so one comparison serves all texts long enough for p.
A text over ``LONG_BYTES`` is dealt out by ranges of lags instead, so that one document may occupy many machines.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.pretokens import batches_of

#: A run has at least so many words, and at least so many times its period.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Longer texts are scanned by ranges of lags, one for each so many bytes: a range costs as many comparisons as the text has
#: words times a constant, and a text is sent as often as it has ranges.
LONG_BYTES = 512 << 10

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_RUNS_SQL = "array<struct<start:long,length:long,period:long>>"
Run = tuple[int, int, int]


def word_ids(words: list[bytes], first: int = 0) -> np.ndarray:
    """A number per distinct word, from ``first`` on."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words), first)}
    return np.fromiter(map(index.__getitem__, words), np.int32, len(words))


def _least_period(x: np.ndarray, p: int) -> bool:
    """Whether ``x``, of period p and at least 2 p long, has no smaller period (which would divide p)."""
    n, r, rest = len(x), 2, p
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            q = p // r
            if x[0] == x[q] and np.array_equal(x[: n - q], x[q:]):
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def scan(arrays: list[np.ndarray], part: int = 0, parts: int = 1) -> list[list[Run]]:
    """(start, length, period) of the runs of each array; arrays must not share ids. Of the lags only the ``part``-th range."""
    out: list[list[Run]] = [[] for _ in arrays]
    order = sorted((i for i, a in enumerate(arrays) if len(a) >= MIN_WORDS), key=lambda i: len(arrays[i]))
    if not order:
        return out
    sizes = np.array([len(arrays[i]) for i in order])
    x, at = np.concatenate([arrays[i] for i in order]), np.concatenate([[0], np.cumsum(sizes)])
    most = int(sizes[-1]) // MIN_EXPONENT
    for p in range(1 + most * part // parts, 1 + most * (part + 1) // parts):
        o = int(at[np.searchsorted(sizes, MIN_EXPONENT * p)])
        same = np.flatnonzero(x[o:-p] == x[o + p :])
        need = max(MIN_WORDS - p, (MIN_EXPONENT - 1) * p)
        if len(same) < need or not (same[need - 1 :] - same[: len(same) - need + 1] == need - 1).any():
            continue
        breaks = np.flatnonzero(np.diff(same) != 1)
        first, last = same[np.concatenate([[0], breaks + 1])], same[np.concatenate([breaks, [len(same) - 1]])]
        long = last - first + 1 >= need
        for s, n in zip((o + first[long]).tolist(), (last - first + 1 + p)[long].tolist()):
            if _least_period(x[s : s + n], p):
                k = int(np.searchsorted(at, s, "right")) - 1
                out[order[k]].append((s - int(at[k]), n, p))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        edge[s + p] += 1
        edge[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def _sorted(runs: list[Run]) -> list[dict]:
    return [{"start": s, "length": n, "period": p} for s, n, p in sorted(runs, key=lambda r: (r[0], r[2]))]


Change = Callable[[object, list[bytes]], list[bytes]]


def _words(text: str, doc_id, change: Change | None) -> list[bytes]:
    words = text.encode().split()  # bytes: splits at 20 and 09-0D only
    return change(doc_id, words) if change else words


def _whole(change: Change | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
        for s, e in batches_of(texts):
            words = [_words(t, i, change) for t, i in zip(texts[s:e], ids[s:e])]
            arrays, first = [], 0
            for w in words:
                arrays.append(word_ids(w, first))
                first += len(w)
            found = scan(arrays)
            rows = [pa.array([_sorted(r) for r in found], _RUNS), pa.array([collapse(w, r) for w, r in zip(words, found)], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s, e - s), pa.array([len(w) for w in words], pa.int64()), *rows], names=["doc_id", "n_words", "runs", "collapsed"])


def _range(change: Change | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            doc_id, text, part, parts = (b.column(c)[i].as_py() for c in ("doc_id", "text", "part", "parts"))
            (runs,) = scan([word_ids(_words(text, doc_id, change))], part, parts)
            yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, 1) for c in ("doc_id", "sha")], pa.array([_sorted(runs)], _RUNS)], names=["doc_id", "sha", "runs"])


def _joined(change: Change | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            words = _words(b.column("text")[i].as_py(), b.column("doc_id")[i].as_py(), change)
            runs = [(r["start"], r["length"], r["period"]) for r in b.column("runs")[i].as_py()]
            rows = [pa.array([len(words)], pa.int64()), pa.array([_sorted(runs)], _RUNS), pa.array([collapse(words, runs).decode()])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), b.column("copies").slice(i, 1), *rows], names=["doc_id", "copies", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, long_bytes: int = LONG_BYTES, change: Change | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start and period, and its words without repetitions.

    Null and empty texts have no words and no runs. Repeated rows and ids have a result each, null ids too; an empty table
    stays empty; further columns, whatever their names, are left out. A text over ``long_bytes`` goes by ranges of lags,
    its equal copies together. ``change(doc_id, words)`` may put other words in place of a row's own; it must give the
    same words each time.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, kind = F.octet_length("text"), docs.schema["doc_id"].dataType.simpleString()
    whole = rows.where(size <= long_bytes).mapInArrow(partial(_whole, change), f"doc_id {kind}, n_words long, runs {_RUNS_SQL}, collapsed string")
    long = rows.where(size > long_bytes).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("sha", F.sha2("text", 256))
    parts = F.ceil(size / long_bytes).cast("int")
    ranges = long.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = ranges.repartition("sha", "doc_id", "part").mapInArrow(partial(_range, change), f"doc_id {kind}, sha string, runs {_RUNS_SQL}")
    runs = found.groupBy("doc_id", "sha").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    key = long["doc_id"].eqNullSafe(runs["doc_id"]) & (long["sha"] == runs["sha"])
    done = long.join(runs, key).select(long["doc_id"], "copies", "text", "runs").mapInArrow(partial(_joined, change), f"doc_id {kind}, copies long, n_words long, runs {_RUNS_SQL}, collapsed string")
    copies = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return whole.unionByName(copies.select(*whole.columns))


# --- the query -------------------------------------------------------------------------------------------------


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """``words``, or for ids whose CRC-32 ends in 0 words that repeat from some place on; a null id has no CRC-32."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), change=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
