"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are split into parts of correlated bits. If the parts' thresholds t_i satisfy sum(t_i + 1) = k + 1, two
fingerprints at distance k or less agree to within t_i bits on some part i (a part with t_i = -1 is not probed). The
thresholds are unequal: a dynamic program picks them, and the number of parts, from candidate counts estimated with
the frequencies of the bits and of every two bits. Fingerprints meet by equal part values (probes flip up to t_i bits),
are verified on all 64 bits, and each bucket hands on a spanning forest of its links, never all its pairs. Components
come from alternating stars. Prints may carry a size; then only prints of similar sizes (factor 1.25) are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, exp, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, releasing

BITS = 64
#: Relative cost of emitting and shuffling one signature against verifying one candidate pair.
PROBE_COST = 100.0
#: Buckets up to this size are compared pair by pair; larger ones are searched breadth-first.
SMALL_BUCKET, SPLIT_BUCKET = 64, 20_000
#: Rows of whole buckets that a task holds at once, where a bucket has no more.
TABLE = 200_000
#: In the second pass, buckets beyond this size are compared root by root.
LARGE_BUCKET = 256


_U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the ``shingle``-word shingles in order, repeats included; a shorter text is one shingle, none has none."""
    words = text.lower().split()  # bytes: A-Z only, and splits at 20 and 09-0D only
    if not words:
        return np.zeros(0, np.uint64)
    m = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: m - 1] + 1]).tolist()
    ends = ends[len(words) - m :].tolist()
    joined, h64 = b" ".join(words), xxhash.xxh64_intdigest
    return np.fromiter((h64(joined[s:e], 42) for s, e in zip(starts, ends)), np.uint64, m)


def majority(h: np.ndarray) -> int:
    """64 bits: each is 1 where over half of the hashes have it; 0 without hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of ``shingle``-word shingles (repeats included); 0 without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, h, fp): the id, a hash of the text as it is, and 64 bits as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column("text").cast(pa.binary()).to_pylist()], _U)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fps.view(np.int64))], names=["doc_id", "h", "fp"])

    return rows_of(docs).mapInArrow(run, "doc_id long, h long, fp long")


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): rows that share id and text hash are copies of one document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and, for every two bits of ``fp``, how many have both; 2,080 sums however many rows there are."""

    def run(batches):
        n, joint = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            x = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, joint = n + len(fps), joint + (x.T @ x).astype(np.int64)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(joint[i, j], n))], names=["i", "j", "n"])

    joint, n = np.zeros((BITS, BITS)), 0
    for r in distinct.mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = r["n"]
        else:
            joint[r["i"], r["j"]] = joint[r["j"], r["i"]] = r["n"]
    return n, joint


def group_bits(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size; each grows by the bit most correlated with its members."""
    p = np.diag(joint) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((joint / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    free, groups = set(range(BITS)), []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        order = sorted(free)
        seed = max(order, key=lambda b: (sum(corr[b, c] for c in order if c != b), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < width:
            best = max(sorted(free), key=lambda b: (sum(corr[b, c] for c in group), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def differing(n: int, joint: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Chance that two fingerprints differ in 0, 1, ... ``most`` bits of ``group``: a beta-binomial with the mean and the
    variance that the frequencies of the bits and of every two of them give, so that correlated bits count as such."""
    width, p, both = len(group), np.diag(joint)[group] / max(1, n), joint[np.ix_(group, group)] / max(1, n)
    only = p[:, None] - both  # the first of two bits without the second
    pairs = 2 * (both * (1 - p[:, None] - p[None, :] + both) + only * only.T)  # both bits differ
    q = 2 * p * (1 - p)
    mean = min(max(float(q.sum()), 1e-9), width - 1e-9)
    variance = float(pairs.sum() - np.trace(pairs) + q.sum()) - mean * mean
    share = mean / width
    rho = 0.0 if width < 2 else (variance / (width * share * (1 - share)) - 1) / (width - 1)
    rho = min(max(rho, 1e-6), 0.99)
    x, y = share * (1 - rho) / rho, (1 - share) * (1 - rho) / rho
    beta = lambda u, v: lgamma(u) + lgamma(v) - lgamma(u + v)
    return np.array([comb(width, d) * exp(beta(d + x, width - d + y) - beta(x, y)) if d <= width else 0.0 for d in range(most + 1)])


def allocate(n: int, joint: np.ndarray, within: int, share: float = 1.0) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated cost: for 2 to within + 1 parts, a dynamic program over sum(t + 1).

    ``share`` is the part of all pairs that other columns leave to compare.
    """
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(2, min(within + 1, BITS) + 1):
        groups, costs = group_bits(n, joint, parts), []
        for g in groups:
            differ = differing(n, joint, g, within)
            row, near, probes = [0.0], 0.0, 0.0
            for t in range(within + 1):
                near, probes = near + differ[t], probes + comb(len(g), t)
                row.append(share * n * n / 2 * near + PROBE_COST * n * (1 + (probes - 1) / 2))
            costs.append(row)  # row[t + 1]
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in costs:
            table = {
                s: min((table[s - u][0] + row[u], table[s - u][1] + [u - 1]) for u in range(len(row)) if s - u in table) for s in range(within + 2) if any(s - u in table for u in range(len(row)))
            }
        cost, ts = table[within + 1]
        if cost < best[0]:
            best = (cost, list(zip(groups, ts)))
    return [(g, t) for g, t in best[1] if t >= 0]


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def signatures(prints: DataFrame, plan: list[tuple[list[int], int]], word: int = 0) -> DataFrame:
    """(key, own, fp, ...): each row under its part values and under the smaller values within the threshold."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                rows = b.slice(start, 2000)
                fps = rows.column("fp").to_numpy(zero_copy_only=False).view(_U)
                for i, (bits, t) in enumerate(plan):
                    v = _values(fps, bits)
                    keys, at, own = [v], [np.arange(len(fps))], [np.ones(len(fps), bool)]
                    for d in range(1, t + 1):
                        for c in combinations(range(len(bits)), d):
                            w = v ^ np.uint64(sum(1 << k for k in c))
                            less = np.flatnonzero(w < v)  # of two fingerprints that differ here, the larger value probes
                            keys.append(w[less])
                            at.append(less)
                            own.append(np.zeros(len(less), bool))
                    k = np.concatenate(keys) * np.uint64(1024) + np.uint64(64 * word + i)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.concatenate(own)), *rows.take(pa.array(np.concatenate(at))).columns], names=["key", "own", *rows.schema.names])

    fields = ", ".join(f"{c} {t}" for c, t in prints.dtypes)
    return prints.mapInArrow(run, f"key long, own boolean, {fields}")


def alike(n, m):
    """Sizes of which the smaller is four fifths of the larger or more."""
    return (5 * n >= 4 * m) & (5 * m >= 4 * n)


def slices(within: int) -> list[tuple[int, int]]:
    """``within`` + 1 ranges of bits that cover all: two linked prints agree on one of them."""
    cuts = [BITS * i // (within + 1) for i in range(within + 2)]
    return list(zip(cuts, cuts[1:]))


def forest(fps: np.ndarray, within: int, sizes: np.ndarray | None = None, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links that connect exactly what all links between the rows connect: a breadth-first search."""
    sizes = np.zeros(len(fps), np.int64) if sizes is None else sizes
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if split and len(fps) > SPLIT_BUCKET and within < BITS:
        for a, b in slices(within):
            v = (fps >> _U(a)) & _U((1 << (b - a)) - 1)
            order = np.argsort(v, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(v[order])) + 1):
                if len(part) > 1:
                    i, j = forest(fps[part], within, sizes[part], split=False)
                    out.append((part[i], part[j]))
    else:
        left = np.arange(len(fps))
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = (np.bitwise_count(fps[left] ^ fps[x]) <= within) & alike(sizes[left], sizes[x])
                if near.any():
                    found = left[near]
                    out.append((np.broadcast_to(x, found.shape), found))
                    queue.extend(found)
                    left = left[~near]
    i, j = (np.concatenate(x) for x in zip(*out))
    return i, j


def distance(prints: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bits in which each row of ``prints`` (several words a row) differs from ``x``."""
    return np.bitwise_count(prints ^ x).sum(1, dtype=np.int64)


def nearest_forest(fps: np.ndarray, within: int, sizes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``forest``, but of the links it takes those of least distance over all words: a minimum spanning forest."""
    n, far = len(fps), np.iinfo(np.int64).max
    best, by, todo, x, out = np.full(n, far), np.zeros(n, np.int64), np.ones(n, bool), 0, []
    while True:
        todo[x] = False
        best[x] = far
        d = distance(prints, prints[x])
        closer = todo & (d < best) & (np.bitwise_count(fps ^ fps[x]) <= within) & alike(sizes, sizes[x])
        best[closer], by[closer] = d[closer], x
        x = int(np.argmin(best))
        if best[x] < far:
            out.append((by[x], x))
        elif todo.any():
            x = int(np.argmax(todo))
        else:
            break
    i, j = np.array(out, np.int64).reshape(-1, 2).T
    return i, j


def _near(key, fps, sizes, own, within: int, other: np.ndarray | None = None):
    """(rows i, rows j, rows with over SMALL_BUCKET others to compare, rows that any pair links): of rows in order of
    (key, size) all pairs are compared, and the linked ones at most SMALL_BUCKET rows apart are listed; where ``other`` is
    given, pairs of unequal ``other`` only."""
    n, act, found, d = len(key), np.arange(len(key)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    touched, more = np.zeros(n, bool), act
    while len(act):
        d += 1
        act = act[act + d < n]
        act = act[(key[act + d] == key[act]) & alike(sizes[act], sizes[act + d])]
        hit = (own[act] | own[act + d]) & (np.bitwise_count(fps[act] ^ fps[act + d]) <= within)
        if other is not None:
            hit &= other[act] != other[act + d]
        at = act[hit]
        touched[at] = touched[at + d] = True
        if d <= SMALL_BUCKET:
            found.append((at, at + d))
            more = act
    i, j = (np.concatenate(x) for x in zip(*found))
    return i, j, more, touched


def bucket_links(key, fps, sizes, own, within: int, prints: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows i, rows j, whether of a forest): links of all buckets of sorted (key, size), every one in small buckets and a
    spanning forest in others; buckets without an own row have nothing that is not found elsewhere."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    counts = np.diff(np.append(starts, len(key)))
    bucket = np.repeat(np.arange(len(starts)), counts)
    worth = (np.add.reduceat(own.astype(np.int64), starts) > 0) & (counts > 1)
    huge = worth & (counts > SPLIT_BUCKET)  # these are split instead of compared row by row
    live = np.flatnonzero((worth & ~huge)[bucket])
    i, j, more, touched = _near(key[live], fps[live], sizes[live], own[live], within)
    i, j = live[i], live[j]
    dense = np.zeros(len(starts), bool)
    dense[bucket[live[more]]] = True
    dense |= np.bincount(bucket[i], minlength=len(starts)) > 2 * counts  # a forest says the same with fewer links
    keep = ~dense[bucket[i]]
    out = [(i[keep], j[keep])]
    rows = live[touched]
    rows = rows[dense[bucket[rows]]]
    for at in np.split(rows, np.flatnonzero(np.diff(bucket[rows])) + 1) if len(rows) else []:
        a, b = forest(fps[at], within, sizes[at]) if prints is None else nearest_forest(fps[at], within, sizes[at], prints[at])
        out.append((at[a], at[b]))
    for s, c in zip(starts[huge], counts[huge]):
        a, b = forest(fps[s : s + c], within, sizes[s : s + c])
        out.append((a + s, b + s))
    listed = len(out[0][0])
    i, j = (np.concatenate(x) for x in zip(*out))
    return i, j, np.arange(len(i)) >= listed


def _apart(fps, sizes, own, root, within: int, split: bool = True) -> np.ndarray:
    """Which rows of one bucket a pair of unequal roots links. Rows of the commonest root are compared with the others
    only, so a bucket of one root costs nothing; a very large bucket is searched by slices of the print."""
    touched = np.zeros(len(fps), bool)
    names, counts = np.unique(root, return_counts=True)
    rest = np.flatnonzero(root != names[np.argmax(counts)])
    if not len(rest):
        return touched
    if split and len(fps) > SPLIT_BUCKET and within < BITS:
        for a, b in slices(within):
            v = (fps >> _U(a)) & _U((1 << (b - a)) - 1)
            order = np.argsort(v, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(v[order])) + 1):
                touched[part[_apart(fps[part], sizes[part], own[part], root[part], within, split=False)]] = True
        return touched
    for x in rest:
        hit = (root != root[x]) & (own | own[x]) & (np.bitwise_count(fps ^ fps[x]) <= within) & alike(sizes, sizes[x])
        if hit.any():
            touched |= hit
            touched[x] = True
    return touched


def bucket_bridges(key, fps, sizes, own, within: int, root) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows i, rows j, dense rows): linked pairs of unequal roots in small buckets, and of the larger buckets the rows that
    such a pair links, for a comparison by more than their prints. Buckets of one root are left out at once."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    counts = np.diff(np.append(starts, len(key)))
    several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    small = np.flatnonzero(np.repeat(several & (counts <= LARGE_BUCKET), counts))
    i, j, more, touched = _near(key[small], fps[small], sizes[small], own[small], within, other=root[small])
    dense = np.unique(key[small[more]])
    keep = ~np.isin(key[small[i]], dense)
    rows = [small[touched & np.isin(key[small], dense)]]
    for s, c in zip(starts[several & (counts > LARGE_BUCKET)], counts[several & (counts > LARGE_BUCKET)]):
        at = slice(s, s + c)
        rows.append(s + np.flatnonzero(_apart(fps[at], sizes[at], own[at], root[at], within)))
    return small[i[keep]], small[j[keep]], np.concatenate(rows)


def whole_keys(batches, most_rows: int) -> Iterator[pa.Table]:
    """Batches in order of ``key`` as tables of ``most_rows`` or more, none of which ends within a key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most_rows:
            t = pa.Table.from_batches(held)
            keys = t["key"].to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield t.slice(0, end)
            held, rows = t.slice(end).combine_chunks().to_batches(), len(t) - end
    if rows:
        yield pa.Table.from_batches(held)


def search(signed: DataFrame, within: int) -> DataFrame:
    """(a, b, tree) with a < b: distinct pairs of nodes linked in some bucket of ``signed`` (key, own, fp[, node, size, w]): at
    least a spanning forest, by distance over fp and w where w is given. Without ``node`` the print is the node. ``tree``
    tells that some bucket listed the pair in place of all its links."""
    several = "w" in signed.columns

    def run(batches):
        for t in whole_keys(batches, TABLE):
            c, sizes = _by_size(t)
            prints = np.stack([c[x].view(_U) for x in ("fp", "w")], 1) if several else None
            i, j, tree = bucket_links(c["key"], c["fp"].view(_U), sizes, c["own"].astype(bool), within, prints)
            node = c.get("node", c["fp"])
            a, b = node[i], node[j]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), tree.astype(np.int64)], 1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(bool))], names=["a", "b", "tree"])

    found = signed.repartition("key").sortWithinPartitions("key").mapInArrow(releasing(run), "a long, b long, tree boolean")
    return found.groupBy("a", "b").agg(F.bool_or("tree").alias("tree"))


def bridges(signed: DataFrame, within: int) -> DataFrame:
    """(a, b, key, own) of ``signed`` (key, own, fp, node, size, root): where key is null, a < b are linked nodes of unequal
    roots; else a is a node and b its print in the large bucket ``key``, where it is linked to some node of another root."""

    def run(batches):
        for t in whole_keys(batches, TABLE):
            c, sizes = _by_size(t)
            i, j, dense = bucket_bridges(c["key"], c["fp"].view(_U), sizes, c["own"].astype(bool), within, c["root"])
            a, b = c["node"][i], c["node"][j]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
            n, none = len(pairs), np.zeros(len(pairs), np.int64)
            blank = np.arange(n + len(dense)) < n
            key = pa.array(np.concatenate([none, c["key"][dense]]), mask=blank)
            own = pa.array(np.concatenate([none.astype(bool), c["own"][dense].astype(bool)]), mask=blank)
            both = [pa.array(np.concatenate([pairs[:, k], c[x][dense]])) for k, x in enumerate(("node", "fp"))]
            yield pa.RecordBatch.from_arrays([*both, key, own], names=["a", "b", "key", "own"])

    return signed.repartition("key").sortWithinPartitions("key").mapInArrow(releasing(run), "a long, b long, key long, own boolean")


def _by_size(t: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns in order of key and size, and the sizes (0 where there are none)."""
    c = {x: t[x].to_numpy() for x in t.schema.names}
    sizes = c["size"].astype(np.int64) if "size" in c else np.zeros(len(t), np.int64)
    order = np.lexsort((sizes, c["key"]))
    return {x: v[order] for x, v in c.items()}, sizes[order]


def links(distinct: DataFrame, within: int = 4) -> DataFrame:
    """(a, b) with a < b: prints linked at ``within`` bits or fewer; of each component at least a spanning forest.

    ``distinct`` (fp) holds distinct prints and nothing else.
    """
    n, joint = bit_statistics(distinct)
    return search(signatures(distinct, allocate(n, joint, within)), within).select("a", "b")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, root) for every node of ``edges`` (a, b) but the roots: alternating large and small stars.

    Rounds consist of minima with partial sums and of equi-joins; each is written to the checkpoint folder.
    """
    e, mark = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for _ in range(most_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low)
        e = cut(small.distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == mark:
            return e.select("a", F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 4, within: int = 4) -> DataFrame:
    """(doc_id, h, fp, component, component_id) for every row of ``docs``; h is a hash of its text.

    Fingerprints at ``within`` differing bits or fewer are linked; component_id is the smallest id that links lead to,
    and component names the component even where ids repeat. Null and empty texts and texts without words have
    fingerprint 0 and are linked like any other. Equal texts share a fingerprint and so a component; repeated ids each
    keep their row. A null id is smaller than none: a component of null ids only has a null id. An empty table gives an
    empty result; other columns are not read.
    """
    prints = cut(fingerprints(docs, shingle))
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = labelled(least.withColumnRenamed("fp", "node"), components(links(least.select("fp"), within)))
    return prints.join(named.withColumnRenamed("node", "fp"), "fp").select("doc_id", "h", "fp", "component", "component_id")


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component, component_id) of ``nodes`` (node, least) under ``roots`` (a, root)."""
    rooted = cut(nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", "least", F.coalesce("root", "node").alias("component")))
    return rooted.join(rooted.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component", "component_id")


def keep_one(docs: DataFrame, found: DataFrame | None = None, **options) -> DataFrame:
    """One row of ``docs`` for each component, columns unchanged: that with the smallest id, null ids last.

    ``found`` has (doc_id, h, component) of every row; without it, they come from ``near_duplicates``. Rows are chosen,
    not ids: rows that share an id but not a component are documents of their own. Of rows with one id in one component
    that with the smallest text hash stays, and of rows with equal id and text the smallest by their columns.
    """
    found = near_duplicates(docs, **options) if found is None else found
    copies = found.groupBy("component", "doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "rows"))
    best = cut(copies.groupBy("component").agg(first.alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.h").alias("__h"), F.col("k.rows").alias("__rows")))
    kept = docs.join(best, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__h"))).drop("__id")
    if best.where("__rows > 1").limit(1).count():
        names = [F.col(f"`{c}`") for c in docs.columns]
        one = kept.where("__rows > 1").groupBy("doc_id", "__h").agg(F.min(F.struct(*names)).alias("__row")).select("__row.*")
        return kept.where("__rows = 1").select(*names).union(one)
    return kept.drop("__h", "__rows")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
