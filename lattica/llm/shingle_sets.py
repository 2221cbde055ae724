"""Near-duplicates by the exact Jaccard similarity of shingle sets; SimHash prints propose the pairs.

The bits of two texts' prints differ with a chance that their similarity gives: of 64 bits about 10 at a similarity of
0.8. Each text has ``WORDS`` prints of 64 bits over the same distinct shingle hashes, and each is searched on its own by
the generalised pigeonhole principle: a pair is proposed if ``WITHIN`` bits or fewer differ in any of them. What is
proposed counts only if the sets themselves are similar enough, in whole numbers.

A bucket first proposes a spanning forest, of a large bucket the one of least distance over two prints, so that a group of
n near copies costs n sets and not n^2. After the components of what held, pairs of a bucket whose components still
differ are compared: in a large bucket all of them by sketches, which count a set's hashes in ``CLASSES`` classes. The
lesser counts of two sketches add up to no less than the hashes that both sets hold, so no pair of the similarity asked
for is lost, and the few that remain are settled by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, releasing
from lattica.llm.simhash import alike, allocate, bit_statistics, bridges, components, labelled, majority, mixed, rows_of, search, shingle_hashes, signatures, whole_keys

#: Prints of a text, and the bits that may differ in one of them.
WORDS, WITHIN = 4, 11
#: Classes of a sketch, a power of two; a class of ``FULL`` hashes or more says nothing.
CLASSES, FULL = 128, 255
_U = np.uint64
_SEEDS = mixed(np.arange(1, WORDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct shingle hashes in order; none for a text without words."""
    return np.unique(shingle_hashes(text, shingle))


def node_of(hashes: np.ndarray) -> int:
    """What all texts with this set are called."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7)


def prints_of(hashes: np.ndarray) -> list[int]:
    return [majority(mixed(hashes ^ s)) for s in _SEEDS]


def sketch_of(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each class by their highest bits, a byte each."""
    shift = _U(64 - (CLASSES.bit_length() - 1))
    return np.minimum(np.bincount((hashes >> shift).astype(np.int64), minlength=CLASSES), FULL).astype(np.uint8).tobytes()


def not_below(x: np.ndarray, y: np.ndarray, n, m, tenths: int) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` with the sketches ``x`` and ``y`` can have a similarity of ``tenths`` / 10."""
    both = np.minimum(x, y).sum(-1, dtype=np.int64)
    return ((10 + tenths) * both >= tenths * (n + m)) | (x == FULL).any(-1) | (y == FULL).any(-1)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, _U).view(np.int64))


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, node, size, w0, w1, ...): h is a hash of the text, node of its set, size the set's."""
    words = [f"w{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, prints = [], [], []
            for t in _texts(b):
                s = shingle_set(t, shingle)
                nodes.append(node_of(s))
                sizes.append(len(s))
                prints.append(prints_of(s))
            table = np.array(prints, _U).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), _longs(nodes), pa.array(sizes, pa.int32()), *[_longs(np.ascontiguousarray(c)) for c in table.T]], names=["doc_id", "h", "node", "size", *words])

    return rows_of(docs).mapInArrow(releasing(run), f"doc_id long, h long, node long, size int, {', '.join(f'{w} long' for w in words)}")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes, sketch) of the nodes in ``wanted`` (node, least), made anew from a text of id ``least`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, shingle) for t in _texts(b)]
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate([*found, np.zeros(0, _U)]).view(np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            sketches = pa.array([sketch_of(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("want"), _longs([node_of(s) for s in found]), hashes, sketches], names=["want", "node", "hashes", "sketch"])

    own = rows_of(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("least"))).select(F.col("node").alias("want"), "text")
    return own.mapInArrow(releasing(run), "want long, node long, hashes array<long>, sketch binary").where("want = node").select("node", "hashes", "sketch").dropDuplicates(["node"])


def compared(dense: DataFrame, within: int, tenths: int) -> DataFrame:
    """(a, b) with a < b: all pairs of unequal roots in a bucket of ``dense`` (key, own, fp, node, size, root, sketch) that
    their prints link and their sketches do not rule out."""

    def pairs_of(c: dict[str, np.ndarray], sketches: np.ndarray) -> Iterator[np.ndarray]:
        node, root, size, fps, own = c["node"], c["root"], c["size"].astype(np.int64), c["fp"].view(_U), c["own"].astype(bool)
        names, counts = np.unique(root, return_counts=True)
        left = np.ones(len(node), bool)
        for x in np.flatnonzero(root != names[np.argmax(counts)]):  # rows of the commonest root meet all of these
            at = np.flatnonzero(left & (root != root[x]) & (own | own[x]) & alike(size, size[x]) & (np.bitwise_count(fps ^ fps[x]) <= within))
            at = at[not_below(sketches[at], sketches[x], size[at], size[x], tenths)]
            yield np.stack([np.minimum(node[at], node[x]), np.maximum(node[at], node[x])], 1)
            left[x] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, 50_000):
            sketches = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, CLASSES)
            c = {x: t[x].to_numpy() for x in t.schema.names if x != "sketch"}
            borders = [0, *(np.flatnonzero(np.diff(c["key"])) + 1), len(t)]
            for s, e in zip(borders, borders[1:]):
                pairs = np.concatenate([*pairs_of({x: v[s:e] for x, v in c.items()}, sketches[s:e]), np.zeros((0, 2), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dense.repartition("key").sortWithinPartitions("key").mapInArrow(releasing(run), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``tenths`` / 10 or more."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    n, m = F.size("x").cast("long"), F.size("y").cast("long")
    return both.where((10 + tenths) * F.size(F.array_intersect("x", "y")).cast("long") >= tenths * (n + m)).select("a", "b")


def comparable(texts: DataFrame) -> float:
    """About which share of all pairs has sizes of a similarity of 0.8; sizes are counted in steps of a quarter."""
    step = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / float(np.log(1.25)))
    n = {r["step"]: r["n"] for r in texts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}  # under 100 rows
    return sum(c * (c + n.get(k + 1, 0)) for k, c in n.items()) / max(1, sum(n.values())) ** 2


def signed_again(now: DataFrame) -> DataFrame:
    """Signatures (key, own, fp, node, size, root) of the rows that are searched a second time. Any parts and thresholds
    find all pairs of them, so these are chosen for their number, which is far below that of all texts: a row has
    signatures as these few rows need them, not as all texts did."""
    words, share = [now.select(F.col(f"w{k}").alias("fp"), "node", "size", "root") for k in range(WORDS)], comparable(now)
    return reduce(DataFrame.union, [signatures(w, allocate(*bit_statistics(w), WITHIN, share), k) for k, w in enumerate(words)])


def links(docs: DataFrame, texts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """(a, root) over the nodes of ``texts`` (node, least, size, w0, ...) that have a near-duplicate."""
    all_words = [f"w{k}" for k in range(WORDS)]
    beside = all_words[1:] + all_words[:1]  # one more print, for distances within a bucket
    words = [texts.select(F.col(w).alias("fp"), "node", "size", F.col(x).alias("w")) for w, x in zip(all_words, beside)]
    share = comparable(texts)
    plans = [allocate(*bit_statistics(w), WITHIN, share) for w in words]
    first = cut(search(reduce(DataFrame.union, [signatures(w, plan, k) for k, (w, plan) in enumerate(zip(words, plans))]), WITHIN))
    touched = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    some = cut(texts.join(touched, "node", "left_semi"))
    sets = cut(sets_of(docs, some.select("node", "least"), shingle))
    held = cut(verified(first, sets, tenths))
    # A bucket that listed all its links has none left: only rows of the others are searched again.
    trees = first.where("tree").select(F.col("a").alias("node")).union(first.where("tree").select("b")).distinct()
    now = cut(some.join(trees, "node", "left_semi").join(components(held).withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    found = cut(bridges(signed_again(now), WITHIN))
    rows = found.where("key is not null").groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct(F.col("b").alias("fp"), "key", "own")).alias("buckets"))  # as many as a node has signatures
    dense = rows.join(now.select("node", "size", "root").join(sets.select("node", "sketch"), "node"), "node").select("node", "size", "root", "sketch", F.explode("buckets").alias("at")).select("node", "size", "root", "sketch", "at.*")
    pairs = found.where("key is null").select("a", "b").union(compared(dense, WITHIN, tenths)).distinct()
    second = cut(pairs.join(first, ["a", "b"], "left_anti"))
    return components(held.union(verified(second, sets, tenths)))


def near_duplicates(docs: DataFrame, shingle: int = 5, tenths: int = 8) -> DataFrame:
    """(doc_id, h, component, component_id) for every row of ``docs``: component_id is the smallest id that links lead
    to, h a hash of the row's text, and component the component's name even where ids repeat.

    Linked are texts whose sets of ``shingle``-word shingles (ASCII case ignored) have a Jaccard similarity of ``tenths``
    / 10 or more and whose prints are near. Null and empty texts and texts without words have the empty set and are one
    component; a null id is smaller than none. An empty table gives an empty result; other columns are not read.
    """
    prints = cut(signed(docs, shingle))
    texts = cut(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), *[F.first(f"w{k}").alias(f"w{k}") for k in range(WORDS)]))
    named = labelled(texts.select("node", "least"), links(docs, texts, shingle, tenths))
    return prints.select("doc_id", "h", "node").join(named, "node").select("doc_id", "h", "component", "component_id")
