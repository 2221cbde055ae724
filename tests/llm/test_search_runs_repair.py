"""Top-k search, periodic runs and conversation repair against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lattica.llm import common, conversations, maxscore, periodic, queries
from tests.duck import same_as_duckdb

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- top-k search --------------------------------------------------------------------------------------------------


def test_op11(spark, sf):
    same_as_duckdb(queries.QUERIES["op11_top_k"](spark, sf), maxscore.OP11_SQL, sf)


def brute_top(q_id, q, rows, k):
    scored = sorted((-int(np.dot(q.astype(object), v.astype(object))), i) for i, v in rows if i != q_id and len(v) == len(q))
    return [(i, -s) for s, i in scored[:k]]


@pytest.mark.parametrize("kind", ["plain", "ties", "negative"])
def test_a_shard_answers_exactly(kind):
    """Many candidates, few values (so many ties), and only negative scores."""
    rng = np.random.default_rng(7)
    v = rng.integers(-40, 40, (3000, 16)) if kind == "plain" else rng.integers(0, 2, (3000, 16)) * (1 if kind == "ties" else -3)
    ids = rng.permutation(5000)[:3000]
    shard = maxscore.Shard(ids, v.astype(float))
    for n in range(40):
        q = rng.integers(-40, 40, 16) if kind == "plain" else rng.integers(0, 3, 16)
        own = int(ids[n]) if n % 2 else None
        got = [(int(i), int(s)) for i, s in zip(*shard.top(own, q.astype(float), 5))]
        assert got == brute_top(own, q, list(zip(ids.tolist(), v)), 5)


def test_non_essential_terms_are_probed_for_few():
    """On vectors with a few heavy dimensions most candidates leave before the last terms are probed."""
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(4000, 64)) * np.r_[np.full(8, 60), np.full(56, 2)]).astype(int)
    shard, seen = maxscore.Shard(np.arange(4000), v.astype(float)), []
    ix = np.ix_
    try:
        np.ix_ = lambda a, b: seen.append(len(b)) or ix(a, b)
        got = shard.top(None, v[3].astype(float), 5)
    finally:
        np.ix_ = ix
    assert [(int(i), int(s)) for i, s in zip(*got)] == brute_top(None, v[3], list(enumerate(v)), 5)
    assert seen and seen[-1] < 400


def test_top_k_on_awkward_rows(spark):
    common.ship(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (None, [2.0, 2.0]), (9, [1e300, -1e300]), (50, [0.25, 0.25])]
    d = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, score string, shard string")
    got = sorted(tuple(r) for r in maxscore.top_k(d.where("vec_id % 50 = 0"), d, k=6).collect())
    ints = [(i if i is not None else maxscore.NO_ID, np.array([max(-(1 << 63), min((1 << 63) - 1, int(np.floor(256 * x)))) for x in v], object)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in (0, 50):
        v = dict(ints)[q]
        for rank, (i, s) in enumerate(brute_top(q, v, ints, 6), 1):
            want.append((q, rank, None if i == maxscore.NO_ID else i, max(-(1 << 63), min((1 << 63) - 1, s))))
    assert got == sorted(want)
    small = maxscore.top_k(d.where("vec_id = 0"), d.where("vec_id < 2"), shard_rows=1, block_rows=1).collect()
    assert [(r["vec_id"], r["rank"]) for r in small] == [(1, 1)]
    assert maxscore.top_k(d, d.limit(0)).collect() == [] == maxscore.top_k(d.limit(0), d).collect()


def test_top_k_over_many_shards_and_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8)).round(2)
    v[100:400] = v[100]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    common.ship(spark)
    ints = [(i, np.floor(256 * x).astype(int)) for i, x in enumerate(v)]
    got: dict = {}
    for r in sorted(maxscore.top_k(d.where("vec_id % 50 = 0"), d, shard_rows=40, block_rows=3).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: brute_top(q, ints[q][1], ints, 5) for q in range(0, 600, 50)}


# --- periodic runs -------------------------------------------------------------------------------------------------


def brute_runs(words):
    n, runs = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                w = words[i : j + p]
                if not any(w[q:] == w[:-q] for q in range(1, p)):
                    runs.append((i, len(w), p))
            i = max(j, i + 1)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_op12(spark, sf):
    found = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        w = WORDS.findall(d["text"] or "")
        n, h = len(w), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        r = found[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)) and r["collapsed_sha256"] == sha(brute_collapsed(w, runs))


def test_runs_of_few_words():
    rng = random.Random(4)
    texts = [[rng.choice([b"a", b"b"][: 1 + k % 2]) for _ in range(rng.randrange(60))] for k in range(300)]
    texts += [[b"a", b"b", b"a", b"c"] * 9, [b"x"] * 5, [b"x"] * 6, [b"x"] * 7 + [b"y"] + [b"x"] * 6, []]
    arrays, first = [], 0
    for t in texts:
        arrays.append(periodic.word_ids(t, first))
        first += len(t)
    found = periodic.scan(arrays)
    for t, runs in zip(texts, found):
        assert sorted(runs, key=lambda r: (r[0], r[2])) == brute_runs(t)
        assert periodic.collapse(t, runs).decode() == brute_collapsed([w.decode() for w in t], runs)
    whole = periodic.scan(arrays[-5:-4])[0]
    assert whole and sorted(whole) == sorted(r for k in range(5) for r in periodic.scan(arrays[-5:-4], k, 5)[0])


def test_runs_on_awkward_rows_and_by_lag_ranges(spark):
    common.ship(spark)
    long = "café 中文 \U0001f600 x " * 3000
    rows = [(None, "a b " * 10), (None, None), (1, ""), (2, " \n\t\x0b"), (3, long), (3, long), (3, "other"), (4, "y z " * 8)]
    d = spark.createDataFrame([(i, t, 1, "r", "c") for i, t in rows], "doc_id long, text string, n_words int, runs string, copies string")
    plain = sorted(map(str, periodic.periodic_runs(d).collect()))
    assert len(plain) == len(rows) and plain == sorted(map(str, periodic.periodic_runs(d, long_bytes=500).collect()))
    assert plain == sorted(map(str, periodic.periodic_runs(d, long_bytes=9000).collect()))
    found = {r["doc_id"]: r for r in periodic.periodic_runs(d).collect() if r["doc_id"] in (1, 4)}
    assert found[1]["runs"] == [] and found[1]["collapsed"] == "" and [tuple(x) for x in found[4]["runs"]] == [(0, 8, 1)]
    assert periodic.periodic_runs(d.limit(0)).collect() == []


# --- conversation repair -------------------------------------------------------------------------------------------


def test_op13(spark, sf):
    same_as_duckdb(queries.QUERIES["op13_repair"](spark, sf), conversations.OP13_SQL, sf)


def brute_repair(rows):
    """rows: (turn, role, text). Least (cost, audit) over all edits, from the last row to the first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, turns = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        chars = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        turns.append((role, text, fault))
    numbers = [r[0] for r in rows if r[0] is not None]
    step = {("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u", ("", "s"): "s"}
    free = {"": "user", "s": "user", "a": "user", "u": "assistant"}

    def inserted(best):
        for _ in range(3):
            for s, role in free.items():
                to = best.get(role[0])
                if to:
                    best[s] = min(best.get(s, to[:0] or (10**9,)), (to[0] + 3, "I" + to[1], [f"{role}:", *to[2]]))
        return best

    best = inserted({"": (0, "", []), "a": (0, "", [])})
    for role, text, fault in reversed(turns):
        out, extra = {}, 3 * (fault == "truncated")
        for s in ("", "s", "u", "a"):
            options = [(best[s][0] + 4, "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                kept, chosen = best.get(step.get((s, role[:1] or " "), "none")), best[free[s][0]]
                options.append((chosen[0] + 3 + extra, "R" + chosen[1], [f"{free[s]}:{text}", *chosen[2]]))
                if kept:
                    options.append((kept[0] + extra, "K" + kept[1], [f"{role}:{text}", *kept[2]]))
            out[s] = min(options)
        best = inserted(out)
    initials = [r[1][:1] or " " for r in rows]
    cost, audit, lines = best[""]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *faults.values(), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(lines)), "\n".join(lines)


@pytest.fixture(scope="module")
def talks():
    rng, out = random.Random(11), {}
    for c in range(60):
        rows = []
        for t in range(rng.choice([1, 2, 5, 9, 40])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""])
            text = rng.choice(["Hi.", "ok?", "cut off", "", "  \n", "é!", "a\nb.", f"{rng.random()}.", f"{rng.random()}"])
            rows.append((rng.choice([t, t, t, t, None, t - 3]), role, text))
        out[c] = rows
    out[60] = [(5, "user", "Same.")] * 30 + [(9, "assistant", "Yes.")] * 3
    return out


@pytest.mark.parametrize("most_rows", [20_000, 0])
def test_repair_in_one_go_and_in_segments(spark, talks, most_rows):
    common.ship(spark)
    d = spark.createDataFrame([(c, t, r, x, "z") for c, rows in talks.items() for t, r, x in rows], "conv_id long, turn long, role string, text string, seg string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(d, most_rows=most_rows).collect()}
    assert got == {c: brute_repair(rows) for c, rows in talks.items()}


def test_repaired_turns_are_legal(spark, talks):
    for rows in talks.values():
        *_, cost, audit, _, text = brute_repair(rows)
        turns = [conversations.Turn(r, x) for _, r, x in rows if x.strip()]
        table = conversations.layer_table(turns, conversations.ENDED)
        _, audit, lines = conversations.trace(turns, table, conversations.START)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines)) and len(audit) - audit.count("I") == len(turns)
        assert conversations.cost(table[0], conversations.START) == sum({"K": 0, "R": 3, "I": 3, "D": 4}[x] for x in audit)


@pytest.mark.parametrize("most_rows", [20_000, 0])
def test_repair_of_awkward_rows(spark, most_rows):
    common.ship(spark)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "x." * 50_000), (1, None, "user", "x." * 50_000), (2, 3, None, "t"), (3, 1, "user", "Gone.")]
    d = spark.createDataFrame([(*r, 0 if r[0] == 3 else 1, "e") for r in rows], "conv_id long, turn long, role string, text string, n int, cost string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(d, "n", most_rows=most_rows).collect()}
    plain = lambda c: [(t, " " if r is None else r, " " if x is None else x) for i, t, r, x in rows if i == c]
    assert got[None] == brute_repair(plain(None)) and got[1] == brute_repair(plain(1)) and got[2] == brute_repair(plain(2))
    assert got[3] == (0, 0, 0, 0, 0, 0, "", sha(""), "")
    assert conversations.repair(d.limit(0)).collect() == []


def test_packed_vectors_are_not_broadcast(spark):
    """shards and blocks are a few rows of megabytes; their estimated size is far below Spark's limit."""
    from pyspark.sql import functions as F

    from lattica.llm import maxscore

    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * k % 7).cast("float") for k in range(4)]).alias("embedding"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    try:
        got = maxscore.top_k(rows.where("vec_id % 50 = 0"), rows, shard_rows=100, block_rows=3)
        assert got.count() == 30
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
