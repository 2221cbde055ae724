"""Stage near_duplicates against brute-force Jaccard, with many pairs on either side of 0.8."""

import random

import numpy as np

import corpus_pipeline as P
from lattica.llm import shingle_sets as S


def brute_kept(texts: dict) -> list:
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + P.SHINGLE]) for i in range(max(1, len(w) - P.SHINGLE + 1))} if w else set()

    sets = {i: shingles(t or "") for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and (sets[i] == sets[j] or 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted(i for i in root if root[i] == i)


def test_near_duplicates_are_those_of_brute_force(spark, sf):
    rng, texts = random.Random(5), {}
    for _ in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 260))]
        for rate in (0.0, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.06):
            texts[len(texts)] = " ".join(f"x{rng.randrange(4000)}" if rng.random() < rate else w for w in base)
    common_start = " ".join(f"c{k}" for k in range(150))  # one passage in many texts: proposed, and to be told apart
    for k in range(40):
        texts[len(texts)] = f"{common_start} {' '.join(f'y{rng.randrange(4000)}' for _ in range(20 + 2 * k))}"
    for t in (None, "", "  \n", "One two", "one TWO", "one two three"):
        texts[len(texts)] = t
    agree(spark, sf, texts)


def test_large_groups_lose_no_link(spark, sf):
    """Over 64 rows in a bucket, most pairs a little below 0.8: a row's one partner can be any other."""
    rng, texts = random.Random(9), {}
    for n in (150, 250):
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        for _ in range(300):
            edits = rng.sample(range(n), rng.randrange(2, n // 60 + 2))
            texts[len(texts)] = " ".join(f"x{rng.randrange(4000)}" if k in edits else w for k, w in enumerate(base))
    assert 20 < len(brute_kept(texts)) < 580, len(brute_kept(texts))
    agree(spark, sf, texts)


def test_sketches_rule_out_no_similar_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 3000, 60_000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for kept in (0.5, 0.85, 0.9, 1.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) < kept], rng.integers(0, 1 << 64, n - int(kept * n), np.uint64)]))
            both = len(np.intersect1d(a, b))
            x, y = (np.frombuffer(S.sketch_of(s), np.uint8) for s in (a, b))
            if 10 * both >= 8 * (len(a) + len(b) - both):
                assert S.not_below(x, y, len(a), len(b), 8)
            elif kept == 0.5 and 40 <= n <= 300:  # of larger sets a sketch says less, and the sets decide
                assert not S.not_below(x, y, len(a), len(b), 8)


def agree(spark, sf, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, docs, sf).collect()) == brute_kept(texts)


def test_a_bucket_of_one_component_costs_nothing():
    import time

    import numpy as np

    from lattica.llm import simhash

    n, rng = 100_000, np.random.default_rng(0)
    fps = np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    start = time.time()
    i, j, dense = simhash.bucket_bridges(np.zeros(n, np.int64), fps, np.full(n, 50), np.ones(n, bool), 11, np.zeros(n, np.int64))
    assert not len(i) and not len(j) and not len(dense) and time.time() - start < 5


def test_large_buckets_find_all_rows_that_other_components_link():
    import numpy as np

    from lattica.llm import simhash

    rng = np.random.default_rng(5)
    for n, within, split in ((400, 4, False), (700, 11, False), (700, 11, True)):
        fps, sizes, root = rng.integers(0, 2**16, n, dtype=np.uint64), rng.integers(40, 60, n), rng.integers(0, 4, n) * (rng.random(n) < 0.3)
        own = rng.random(n) < 0.8
        pair = (np.bitwise_count(fps[:, None] ^ fps) <= within) & (root[:, None] != root) & (own[:, None] | own) & simhash.alike(sizes[:, None], sizes)
        most, simhash.SPLIT_BUCKET = simhash.SPLIT_BUCKET, 100 if split else simhash.SPLIT_BUCKET
        try:
            *_, dense = simhash.bucket_bridges(np.zeros(n, np.int64), fps, sizes, own, within, root)
        finally:
            simhash.SPLIT_BUCKET = most
        assert set(dense.tolist()) == set(np.flatnonzero(pair.any(1)).tolist())


def test_second_search_has_signatures_for_its_own_rows(spark):
    """Few rows need few signatures, however many texts the first search had; every linked pair still meets."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 64, (30, S.WORDS), np.uint64)
    rows = []
    for n in range(300):
        flips = [sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(S.WORDS)]
        rows.append((n, 100, n, *[int(np.uint64(int(w) ^ f).astype(np.int64)) for w, f in zip(base[n % 30], flips)]))
    now = spark.createDataFrame(rows, f"node long, size int, root long, {', '.join(f'w{k} long' for k in range(S.WORDS))}")
    signed = S.signed_again(now)
    assert signed.count() <= 300 * S.WORDS * (S.WITHIN + 1)
    found = S.bridges(signed, S.WITHIN).where("key is null").select("a", "b").distinct().collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and any(((a[k] ^ b[k]) & (2**64 - 1)).bit_count() <= S.WITHIN for k in range(3, 3 + S.WORDS))}
    assert len(want) > 1000 and {(r["a"], r["b"]) for r in found} == want
