"""Exact top-k inner products by MaxScore.

A dimension is a query term, its column over the candidates the term's postings. Candidates are dealt into shards, queries
into blocks, and every block meets every shard once. Within a shard a term's contribution to a score lies between two
bounds. The terms that cannot reach the k-th best score together, though each gave its most, are non-essential: scores are
accumulated over the postings of the others only, and the rest are probed in order of their bounds while a candidate stays
competitive. Each shard hands on its best rows for a query, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Candidates of a shard and queries of a block, on average.
SHARD_ROWS, BLOCK_ROWS = 8192, 2048
#: Candidates that are scored in full to find a first k-th best score, and terms that are probed between two looks at the bounds.
SEED_ROWS, PROBE = 512, 8
#: Sums of whole numbers below this are exact in doubles.
EXACT = float(1 << 53)
#: Stands for a null id.
NO_ID = (1 << 63) - 1


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are null, empty or hold null or non-finite components.

    Components beyond 64 bits become the largest or smallest long.
    """
    x = vector.cast("array<double>")
    fine = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))))


# --- one query against one shard ---------------------------------------------------------------------------------


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, equal scores by id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


class Shard:
    """Candidates by ascending id, one row of ``postings`` per dimension, with each dimension's least and greatest value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(vectors[order].T)
        self.least, self.most = self.postings.min(axis=1), self.postings.max(axis=1)

    def top(self, own: int | None, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates for ``q`` whose id is not ``own``."""
        post, n = self.postings, len(self.ids)
        high, low = np.maximum(q * self.least, q * self.most), np.minimum(q * self.least, q * self.most)
        order = np.argsort(low - high, kind="stable")  # the widest range first
        rest = np.concatenate([np.cumsum(high[order][::-1])[::-1], [0]])  # what the terms from the i-th on add at most
        others = np.ones(n, bool) if own is None else self.ids != own
        seed = np.flatnonzero(others[:SEED_ROWS])
        first = q @ post[:, seed]
        at = _best(self.ids[seed], first, k)
        found, scores = seed[at], first[at]
        if n <= SEED_ROWS:
            return self.ids[found], scores
        bar = scores[-1] if len(found) == k else None
        left = np.flatnonzero(others[SEED_ROWS:]) + SEED_ROWS
        # Non-essential: even at their most, on a candidate that has the least of all others, they stay below the bar.
        essential = len(q)
        if bar is not None:
            reach = low.sum() + np.concatenate([np.cumsum((high - low)[order][::-1])[::-1], [0]])
            essential = int(np.argmax(reach < bar)) if (reach < bar).any() else len(q)
        total = np.zeros(n - SEED_ROWS)
        for j in order[:essential]:
            total += q[j] * post[j, SEED_ROWS:]
        total = total[left - SEED_ROWS]
        for i in range(essential, len(q), PROBE):
            if bar is not None:
                stay = total + rest[i] > bar  # ids ascend: an equal score behind the seed loses to it
                left, total = left[stay], total[stay]
            if not len(left):
                break
            some = order[i : i + PROBE]
            total = total + q[some] @ post[np.ix_(some, left)]
        pool, sums = np.concatenate([found, left]), np.concatenate([scores, total])
        at = _best(self.ids[pool], sums, k)
        return self.ids[pool[at]], sums[at]


def _plain_top(ids: np.ndarray, vectors: np.ndarray, own: int | None, q: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """For numbers whose sums doubles cannot hold: every candidate in whole numbers of any size, clipped to 64 bits."""
    scores = vectors.astype(object) @ q.astype(object)
    rows = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if own is None or i != own)[:k]
    return [i for _, i in rows], [max(-(1 << 63), min((1 << 63) - 1, -s)) for s, _ in rows]


def _pairs(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, shard = None, None
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in b.schema.names}
            ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
            vectors, qs = (np.frombuffer(row[c], "<i8").reshape(len(n), row["dim"]) for c, n in (("vectors", ids), ("q_vectors", q_ids)))
            reach = float(np.abs(vectors.astype(float)).max()) * float(np.abs(qs.astype(float)).max()) * row["dim"] * 4
            if reach < EXACT and last != (row["dim"], row["shard"]):
                last, shard = (row["dim"], row["shard"]), Shard(ids, vectors.astype(float))
            out: dict[str, list] = {"query_id": [], "q_key": [], "vec_id": [], "score": []}
            for at, (own, q) in enumerate(zip(q_ids.tolist(), qs)):
                found, scores = shard.top(own, q.astype(float), k) if reach < EXACT else _plain_top(ids, vectors, own, q, k)
                out["query_id"] += [own] * len(found)
                out["q_key"] += [f"{row['dim']}:{row['block']}:{at}"] * len(found)
                out["vec_id"] += [int(x) for x in found]
                out["score"] += [int(x) for x in scores]
            yield pa.RecordBatch.from_arrays([pa.array(out["query_id"], pa.int64()), pa.array(out["q_key"], pa.string()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.int64())], names=list(out))


def _packed(table: pa.Table) -> pa.Table:
    """One row for a shard or block: its ids, and its vectors one behind the other."""
    vectors = table["v"].combine_chunks()
    ids, order = table["vec_id"].to_numpy(), np.argsort(table["vec_id"].to_numpy(), kind="stable")
    flat = vectors.flatten().to_numpy().reshape(len(ids), -1)
    return pa.table({"dim": pa.array([flat.shape[1]], pa.int32()), "part": pa.array([table["part"][0].as_py()], pa.int64()), "ids": [ids[order].astype("<i8").tobytes()], "vectors": [flat[order].astype("<i8").tobytes()]})


def _parts(rows: DataFrame, n: int) -> DataFrame:
    """(dim, part, ids, vectors): rows dealt by a hash of id and vector into about ``n`` parts for each dimension."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("long")).withColumn("dim", F.size("v"))
    return dealt.groupBy("dim", "part").applyInArrow(_packed, "dim int, part long, ids binary, vectors binary")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by inner product of floor(scale * x), ties by id.

    Both tables have (vec_id, embedding); other columns are left out. Candidates with the query's own id are not its
    results. Vectors that are null, empty or hold null or non-finite components take no part, and vectors of different
    lengths do not meet. Null ids are one id, the last among ties; the largest long stands for it and must not be an id.
    A candidate row that is there twice counts twice; a query row that is there twice is answered once. Without queries or
    candidates there are no rows; fewer than k candidates are all returned. Scores beyond 64 bits are clipped.
    """
    clean = lambda d: d.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("v")).where("v is not null")
    q = clean(queries).distinct()
    # Of equal rows no more than k can be among the best.
    c = clean(candidates).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).select("vec_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k).cast("long")))).alias("copy"))
    n_q, n_c = (max(1, -(-d.count() // rows)) for d, rows in ((queries, block_rows), (candidates, shard_rows)))
    blocks = _parts(q, n_q).select("dim", F.col("part").alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    shards = _parts(c.select("vec_id", "v"), n_c).withColumnRenamed("part", "shard")
    # A stated set of queries against all rows: every block once to every shard, both of bounded size.
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))
    # Neither side may be broadcast: packed rows count as few bytes in Spark's estimates. A shard is one row of its key.
    met = sent.join(shards.hint("merge"), ["dim", "shard"]).select("dim", "shard", "block", "ids", "vectors", "q_ids", "q_vectors")
    found = met.mapInArrow(partial(_pairs, k), "query_id long, q_key string, vec_id long, score long")
    first = F.row_number().over(W.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.withColumn("rank", first).where(F.col("rank") <= k).select(known("query_id"), F.col("rank").cast("int").alias("rank"), known("vec_id"), "score")


def op11_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows.where("vec_id % 50 = 0"), rows)


OP11_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
