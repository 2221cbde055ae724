"""Each operator against a brute-force version, an exact round trip or its SQL, and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lattica.llm import bpe_transducer, common, jpeg, language_model, mixing, pretokens, quality, queries, shingle_sets, simhash, suffix_dedup, token_counts, token_file, url_filter
from tests.duck import same_as_duckdb

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
JSON, RANKS = pretokens.tokenizer_path("byte_bpe_50k.json"), pretokens.tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def run(spark, sf, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf).collect()}


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# --- whole tables against brute force --------------------------------------------------------------------------


def brute_print(text: str, n: int = 4) -> int:
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = WORDS.findall(words)
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(prints: dict, within: int) -> dict:
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= within:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op1(spark, sf, docs):
    found = run(spark, sf, "op1_simhash")
    prints = {i: brute_print(t) for i, t in docs.items()}
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in found.items()} == brute_components(prints, 4)


@pytest.mark.parametrize("within", [2, 4, 9])
def test_links_lose_no_component(spark, within):
    rng = np.random.default_rng(within)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, within + 3), replace=False)) for b in base for _ in range(12)]
    prints = dict(enumerate(near))
    signed = {int(np.uint64(p).view(np.int64)): p for p in near}
    common.ship(spark)
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), within)).collect()
    root = {signed[r["a"]]: r["root"] for r in found}
    want = brute_components(dict(enumerate(signed.values())), within)
    groups = collections.defaultdict(set)
    for i, x in enumerate(signed):
        groups[want[i]].add(root.get(signed[x], x))
    assert all(len(g) == 1 for g in groups.values()) and len({*map(min, groups.values())}) == len(groups)


@pytest.mark.parametrize("within", [4, 8, 12, 13, 20])
def test_a_large_bucket_loses_no_link(within):
    rng = np.random.default_rng(within)
    fps = rng.integers(0, 2**63, simhash.SPLIT_BUCKET + 1, dtype=np.uint64)
    pairs = [(k, len(fps) + k) for k in range(40)]
    near = [int(fps[k]) ^ sum(1 << int(b) for b in rng.choice(64, within, replace=False)) for k in range(40)]
    i, j = simhash.forest(np.concatenate([fps, np.array(near, np.uint64)]), within)
    root = list(range(len(fps) + len(near)))

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a, b in zip(i.tolist(), j.tolist()):
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in pairs)


def test_slices_cover_all_bits():
    for within in range(64):
        found = simhash.slices(within)
        assert len(found) == within + 1 and [b for a, z in found for b in range(a, z)] == list(range(64)) and all(a < z for a, z in found)


def test_correlated_bits_raise_the_estimate():
    rng = np.random.default_rng(2)
    bits = np.repeat(rng.integers(0, 2, (4000, 8)), 8, axis=1)  # eight bits, each eight times
    joint = (bits.T @ bits).astype(float)
    group = list(range(16))
    d = simhash.differing(4000, joint, group, 16)
    true = np.bincount((bits[:2000, :16] != bits[2000:, :16]).sum(1), minlength=17) / 2000
    assert d.sum() == pytest.approx(1, abs=1e-6) and d[0] > 50 * 2.0**-16 and abs(d[:3].sum() - true[:3].sum()) < 0.25


def test_a_large_bucket_is_searched_exactly():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 2**20, 30_000, dtype=np.uint64))
    whole = simhash.forest(fps, 3, split=False)
    parts = simhash.forest(fps, 3)

    def classes(found):
        root = {}

        def find(i):
            while root.setdefault(i, i) != i:
                i = root[i]
            return i

        for a, b in zip(*(x.tolist() for x in found)):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {i: find(i) for i in root}

    assert classes(whole) == classes(parts)


def test_op2_and_op7(spark, sf, docs):
    tool = pretokens.Library(JSON).tokenizer
    ids = {i: tool.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    counted = run(spark, sf, "op2_token_counts")
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in counted.items()} == {i: (len(docs[i].encode()), len(x), len(x) > 1024) for i, x in ids.items()}
    found, start = run(spark, sf, "op7_token_file"), 0
    for i in sorted(ids):
        raw = np.array([*ids[i], 2], "<u4").tobytes()
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4


def brute_passages(docs: dict, length: int) -> dict:
    first, out = set(), {}
    for i in sorted(docs):
        t = docs[i].encode()
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            w = t[a : a + length]
            if w in first:
                gone[a : a + length] = b"\1" * length
            first.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def test_op3(spark, sf, docs):
    found = run(spark, sf, "op3_suffix_dedup")
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in found.items()} == brute_passages(docs, 100)


def test_op3_with_frequent_anchors(spark, sf, docs):
    """Anchors of over ``hot`` runs go the other way, small blocks share passages, and periodic texts overlap themselves."""
    common.ship(spark)
    some = {i: t[:4000] for i, t in list(docs.items())[:60]} | {1000: "ab" * 400, 1001: "ab" * 300, 1002: "x" * 99, 1003: "x" * 250}
    frame = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    left = suffix_dedup.dedup(frame, length=40, gram=12, block_bytes=20_000, hot=1).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in left} == brute_passages(some, 40)


def test_op4(spark, sf):
    same_as_duckdb(queries.QUERIES["op4_url_filter"](spark, sf), url_filter.OP4_SQL, sf)


def test_op4_rules_and_reputation(spark):
    urls = ["https://WWW.Example.com/en/x", "http://example.com/en/", "http://a.example.com/de/", "http://x.net/fr/y?z", "http://x.net/fry", "nothing", None, "http://bad.org/a", "http://good.org/a", "http://bad.org?x/en/"]
    labels = [(7, True)] * 30 + [(8, False)] * 30
    pages = spark.createDataFrame([(i, u, 9) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    found = {r["page_id"]: r for r in url_filter.filter_urls(pages, spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert [found[i]["rule"] for i in range(7)] == ["www.example.com/en/", "example.com/en/", "com/", "net/fr/", None, None, None]
    assert [found[i]["verdict"] for i in (0, 1, 2, 3, 7, 8, 9)] == ["allow", "block", "allow", "block", "block", "allow", "block"]
    assert (found[5]["host"], found[6]["host"], found[9]["path"]) == ("", "", "")


def test_op5(spark, sf, docs):
    found = run(spark, sf, "op5_quality_rules")
    for i, t in docs.items():
        w = WORDS.findall(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = collections.Counter(tri)
        repeat = {p for k, x in enumerate(tri) if c[x] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert tuple(found[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert found[i]["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        assert not (found[i]["base_failed"] and found[i]["kept"])


def test_op5_parts_good_from_bad(spark, sf):
    """Held-out accuracy: labels that the target was not fitted on."""
    sf = sf.replace("sf0.001", "sf0.1")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").dropDuplicates(["doc_id"])
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = quality.judge(d, fit).select("own.doc_id", "kept", "base_failed").join(held, "doc_id").where("not base_failed").collect()
    right = [r["kept"] == (r["quality"] == 1) for r in judged]
    assert len(right) > 50 and sum(right) / len(right) > 0.9


def test_op6(spark, sf, docs):
    words = {i: t.encode().split() for i, t in docs.items()}
    grams = [collections.Counter(tuple(w[k : k + n]) for w in words.values() for k in range(len(w) - n + 1)) for n in (1, 2)]
    total = sum(map(len, words.values()))
    found = run(spark, sf, "op6_lm_scoring")
    for i, w in words.items():
        own = [collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for n in (1, 2)]
        count = lambda g: grams[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        score = 0.0
        for k in range(len(w)):
            one, two = count((w[k],)), count((w[k - 1], w[k])) if k else 0
            back = math.log(0.4) if k else 0.0
            if two and count((w[k - 1],)):
                score += math.log(two / count((w[k - 1],)))
            elif one:
                score += back + math.log(one / (total - len(w)))
            else:
                score += back + math.log(0.4) - math.log(total - len(w) + 1)
        assert found[i]["n_words"] == len(w)
        assert found[i]["log_score"] == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_totals_beyond_32_bits():
    keys, many = np.array([3, 2**40], np.uint64), np.array([2**32 - 1, 5])
    asked = [common.requests(b, keys, many, 1) for b in range(3)]
    told = common._total(pa.concat_tables(asked))
    assert all((common.totals(told.slice(b, 1)) == [3 * (2**32 - 1), 15]).all() for b in range(3))


def test_op7_files_find_broken_blocks(rng=np.random.default_rng(3)):
    ids = (rng.zipf(1.3, 70_000) % 5000).astype(np.int64)
    coder = token_file.Coder(token_file.quantise(np.bincount(ids)))
    payload, states, lengths, sums = coder.encode(ids)
    assert (coder.decode(payload, states, lengths, sums, len(ids)) == ids).all()
    assert len(payload) < ids.size * 1.6
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(broken), states, lengths, sums, len(ids))
    assert len(coder.decode(*coder.encode(ids[:0]), 0)) == 0


def test_op8(spark, sf):
    same_as_duckdb(queries.QUERIES["op8_mix_sources"](spark, sf), mixing.OP8_SQL, sf)


def test_op8_comes_near_its_targets(spark, sf):
    d = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet")
    rows = mixing.mix(d).selectExpr("source", "target", "taken", "size").collect()
    got, want = collections.Counter(), {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        got[r["source"]] += r["taken"]
        want[r["source"]] = r["target"]
    assert all(abs(got[s] - t) <= 0.02 * t + 20_000 for s, t in want.items())


def test_op9(spark, sf, docs):
    import tiktoken

    tool = tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=bpe_transducer.load_ranks(RANKS), special_tokens={})
    found = run(spark, sf, "op9_bpe")
    for i, t in docs.items():
        ids = tool.encode_ordinary(t)
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode()))


def test_op9_odd_pieces():
    ranks = bpe_transducer.load_ranks(RANKS)
    machine, rng = bpe_transducer.Transducer(ranks, limit=50), np.random.default_rng(5)
    for n in (1, 2, 3, 7, 40, 300):
        for piece in (b"a" * n, b"ab" * n, bytes(rng.integers(0, 256, n, dtype=np.uint8)), ("é中\U0001f600" * n).encode()):
            assert machine.encode(piece) == bpe_transducer.merge(piece, ranks)
    text = "aé中\U0001f600"
    held: list[int] = []
    for piece in (b"a" * 5000, b"ab" * 3000, b" " * 4000, ("Erwhtion" * 400).encode(), bytes(rng.integers(97, 123, 6000, dtype=np.uint8))):
        ids, most = [], 0
        for t in machine.stream(piece, held):
            ids.append(t)
            most = max(most, len(held))
        assert b"".join(machine.bytes_of[t] for t in ids) == piece and ids == bpe_transducer.merge(piece, ranks)
        assert most <= bpe_transducer.SETTLE + 2 * max(map(len, ranks))  # labels behind what is settled are dropped
        held.clear()
    pieces = list(bpe_transducer.Decoder(ranks).stream([ranks[bytes((b,))] for b in text.encode()], step=1))
    assert "".join(s for _, s in pieces) == text and b"".join(b for b, _ in pieces) == text.encode()


def test_op10(spark, sf, docs):
    found = run(spark, sf, "op10_media")
    for i, t in docs.items():
        raw = t.encode()
        full = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), sha(full), zlib.crc32(full[-16:]))
        assert (sha(jpeg.encode([full])[0]), len(jpeg.encode([full])[0])) == (r["media_sha256"], r["media_bytes"])


def test_op10_broken_images(spark):
    good = jpeg.encode([bytes(range(192))])[0]
    rows = [(1, good), (2, good[:50]), (3, b""), (4, None), (5, good[:-2]), (6, good)]
    found = {r["doc_id"]: r for r in jpeg.features(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert found[1]["error"] is None and (found[1]["width"], found[1]["height"]) == (192, 64)
    assert found[6]["thumb_sha256"] == found[1]["thumb_sha256"] == sha(bytes(range(192)))
    assert all(found[i]["error"] and found[i]["width"] is None for i in (2, 3, 4, 5))


# --- awkward rows ----------------------------------------------------------------------------------------------

LONG = ("lorem ipsum dolor sit amet " * 40_000).strip()
AWKWARD = [(None, "a b c d e f"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (5, "café 中文 \U0001f600 <|endoftext|> x"), (5, "other"), (6, "x"), (7, "x")]
CLASH = "ids,size,copies,media,key,block,part,fp,h,n,n_words,kept,grams,own,words,hashes,p_source,token,start"


@pytest.fixture(scope="module")
def awkward(spark):
    from pyspark.sql import functions as F

    common.ship(spark)
    d = spark.createDataFrame([(i, t, None if k % 3 == 0 else f"s{k % 2}") for k, (i, t) in enumerate(AWKWARD)], "doc_id long, text string, source string")
    return d.select("*", *[F.lit("extra").alias(c) for c in CLASH.split(",")])


def _jpeg(d):
    return jpeg.features(jpeg.store(d))


def _tokens(d):
    import tempfile

    folder = tempfile.mkdtemp(prefix="tokens-") + "/t"
    token_file.write_tokens(d, folder, JSON)
    return token_file.read_tokens(d.sparkSession, folder)


def _labels(d):
    return d.sparkSession.createDataFrame([(4, 1, 0), (4, 0, None), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "simhash": simhash.near_duplicates,
    "token_counts": lambda d: token_counts.count_tokens(d, JSON),
    "suffix_dedup": suffix_dedup.dedup,
    "quality": lambda d: quality.judge(d, _labels(d)),
    "language_model": language_model.score_documents,
    "token_file": _tokens,
    "mixing": mixing.mix,
    "bpe": lambda d: bpe_transducer.decode_documents(bpe_transducer.encode_documents(d, RANKS), RANKS),
    "jpeg": _jpeg,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_a_result(awkward, name):
    assert len(OPERATORS[name](awkward).collect()) == len(AWKWARD)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(awkward, name):
    assert OPERATORS[name](awkward.limit(0)).collect() == []


A, B, C = "alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red orange yellow green blue indigo"


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(5, A), (5, B), (7, C)], [(5, A), (5, B), (7, C)]),
        ([(1, B), (5, A), (5, B)], [(1, B), (5, A)]),
        ([(5, A), (5, A), (5, A.upper()), (9, A)], [(5, None)]),  # one id, two spellings: one row stays
        ([(None, A), (3, A), (None, B), (None, B)], [(3, A), (None, B)]),
    ],
)
def test_keep_one_chooses_rows(spark, rows, want):
    common.ship(spark)
    d = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, component string")
    for found in (None, shingle_sets.near_duplicates(d)):
        got = simhash.keep_one(d, found).collect()
        assert sorted(((r["doc_id"] or 0), r["text"] if w[1] else None) for r, w in zip(sorted(got, key=lambda r: (r["doc_id"] or 99, r["text"])), want)) == sorted((i or 0, t) for i, t in want)
        assert len(got) == len(want)


def test_awkward_values(awkward):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(awkward).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (6, 6), (7, 6)} <= got
    left = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup(awkward).collect() if r["doc_id"] == 4]
    assert sorted(x[2] for x in left)[1] == len(LONG)
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    # the null text of a null id is a copy of document 1; "a b c d e f" of a null id is like no other
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept.collect()) == [(0, "a b c"), (1, ""), (4, "lorem"), (5, "café "), (5, "other"), (6, "x")]
    kept = quality.keep_good(awkward, _labels(awkward))
    assert kept.columns == awkward.columns
    mixed = mixing.mix(awkward).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in mixed) and {r["size"] for r in mixed if r["doc_id"] in (1, 2, 3)} == {0}


def test_remembered_pieces_are_those_of_the_library_and_the_ranks():
    """Pre-tokens of plain texts take a shorter way to the library and to the transducer, whose states are plain numbers."""
    texts = ["Plain words, plain  words\n\tand 12 numbers 3.5 don't", " ", "", "  two", "naïve façade Ärger ñandú, Łódź", "x<|endoftext|>y plain", "\x00\x1f \x7f", "日本語 mixed é", "a\u00a0b it's 'll"]
    library = pretokens.Library(JSON)
    memo = library.memo()
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.ids(texts)] == [library.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(library.single(" words")) == library.encode(" words")
    ranks = bpe_transducer.load_ranks(RANKS)
    memo = bpe_transducer._tools(RANKS)[0]
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.ids(texts)] == [[i for p in pretokens.pretokens(t) for i in bpe_transducer.merge(p.encode(), ranks)] for t in texts]
    machine = bpe_transducer.Transducer(ranks)
    machine.encode(b" transducers")
    assert len(machine.states) > 5 and all(isinstance(x, int) for s in machine.states for x in s)
