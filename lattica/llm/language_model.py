"""Stupid-backoff scores from n-gram counts of the whole corpus, each document scored without its own counts.

Blocks of documents ask for the totals of their distinct n-grams; the count table is partitioned by the n-grams' 64-bit
hashes and joined to what was asked; the totals return to the blocks, where a document's own counts are taken off and
its words' log scores are summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lattica.llm.common import ASK, answers, blocked, in_order, lookup_parts, requests, text_size, totals

#: The factor of every step to a shorter context.
BACKOFF = 0.4
_U = np.uint64
_TOTAL = _U(0)  # the key under which blocks report their number of words


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return np.maximum(h ^ (h >> _U(32)), _U(1))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def ngrams(text: bytes, order: int, seen: _Words) -> list[np.ndarray]:
    """Keys of the n-grams that start at each word, for n from 1 to ``order``."""
    words = text.split()
    h = np.fromiter(map(seen.__getitem__, words), _U, len(words))
    out = [_mixed(h)]
    for n in range(2, order + 1):
        m = max(0, len(words) - n + 1)
        out.append(_mixed(out[-1][:m] * _U(0x9E3779B97F4A7C15) + h[n - 1 : n - 1 + m] + _U(n)))
    return out


def _block_keys(texts: list[bytes], order: int) -> tuple[list[list[np.ndarray]], np.ndarray, np.ndarray]:
    seen = _Words()
    grams = [ngrams(t, order, seen) for t in texts]
    n = sum(len(g[0]) for g in grams)
    keys, counts = np.unique(np.concatenate([x for g in grams for x in g] or [np.zeros(0, _U)]), return_counts=True)
    return grams, np.concatenate([[_TOTAL], keys]), np.concatenate([[n], counts])


def _ask(order: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        _, keys, counts = _block_keys(in_order(table)[1], order)
        return requests(table["block"][0].as_py(), keys, counts, parts)

    return run


def word_scores(grams: list[np.ndarray], keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Log score of each word: the longest context in which the word is seen elsewhere, else 1 / (all words + 1)."""
    order, n = len(grams), len(grams[0])
    other = []  # counts outside this document, by order
    for g in grams:
        _, where, own = np.unique(g, return_inverse=True, return_counts=True)
        other.append(count[np.searchsorted(keys, g)].astype(np.int64) - own[where])
    rest = int(count[0]) - n
    best = np.minimum(order, np.arange(n) + 1)  # the longest n-gram that ends at each word
    score, done = np.zeros(n), np.zeros(n, bool)
    for k in range(order, 0, -1):
        at = np.arange(k - 1, n)  # words at which n-grams of k words end
        hits = other[k - 1]
        base = other[k - 2][: len(hits)] if k > 1 else np.full(len(hits), rest)
        good = (hits > 0) & (base > 0) & ~done[at]
        to = at[good]
        score[to] = np.log(hits[good] / base[good]) + (best[to] - k) * np.log(BACKOFF)
        done[to] = True
    score[~done] = best[~done] * np.log(BACKOFF) - np.log(rest + 1)
    return score


def _score(order: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts = in_order(docs)
        grams, keys, _ = _block_keys(texts, order)
        count = totals(told)
        sums = [float(word_scores(g, keys, count).sum()) for g in grams]
        n = [len(g[0]) for g in grams]
        mean = [s / k if k else None for s, k in zip(sums, n)]
        return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sums), pa.array(mean, pa.float64())], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    return run


def score_documents(docs: DataFrame, order: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score): scores of each text's words under all other documents' n-grams.

    Words are whole runs of anything but ASCII white space. A text without words (null, empty) scores 0 with a null
    mean. Equal texts score alike; repeated ids and null ids keep their rows and count as documents of their own. An
    empty table gives an empty result; other columns are not read.
    """
    blocks = blocked(docs, block_bytes)
    told = answers(blocks.groupBy("block").applyInArrow(_ask(order, lookup_parts(text_size(docs))), ASK))
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(order), "doc_id long, n_words long, log_score double, mean_log_score double")


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
