"""Exact removal of repeated passages with a distributed, hash-compared suffix sort.

Which suffixes can share their first ``length`` bytes is settled first, so that only those are sorted:

1. Every window of ``length`` bytes names its anchor, the ``gram``-byte substring of smallest hash in it. Equal windows
   have equal anchors at equal offsets. Neighbouring windows with one anchor form a run (about 35 windows).
2. Blocks ask how often each anchor hash occurs in the corpus. Runs whose anchor occurs once hold nothing repeated.
3. The other runs travel, with their bytes, to the task of their anchor. A block sends equal runs once. Anchors of more
   than ``hot`` runs send their windows singly, dealt by the windows' own hashes, so no group grows without bound.
4. A task sorts the suffixes of its runs by mergesort. Two suffixes are compared by their longest common extension:
   prefix polynomial hashes and a binary search, so in a logarithmic number of steps. Neighbours that share ``length``
   bytes (verified byte by byte) form a class; all but its first member (by document, then position) are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import ASK, answers, blocked, in_order, lookup_parts, ordered, requests, text_size, totals

_BASE = 0x9E3779B97F4A7C15 | 1
#: Window starts that are hashed at a time, which bounds a task's memory on long documents.
CHUNK = 1 << 18
_U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up = np.full(n, _BASE, _U)
    up[0] = 1
    down = np.full(n, pow(_BASE, -1, 1 << 64), _U)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Hashes:
    """Prefix polynomial hashes of a byte array: ``of(i, n)`` hashes the n bytes from i, position-independently."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(19, len(data).bit_length() + 1)
        if size not in _POWERS:
            _POWERS.clear()
            _POWERS[size] = _powers(size)
        up, self.down = _POWERS[size]
        self.prefix = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=self.prefix[1:])

    def of(self, i, n):
        return (self.prefix[i + n] - self.prefix[i]) * self.down[i]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: polynomial hashes have weak low bits."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor position and anchor hash of each run of one text's windows."""
    found, w = [], length - gram + 1
    for a in range(0, len(data) - length + 1, CHUNK):
        n = min(CHUNK, len(data) - length + 1 - a)  # window starts in this chunk
        part = data[a : a + n + length - 1]
        grams = mixed(Hashes(part).of(np.arange(len(part) - gram + 1), gram))
        pick = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
        pad = np.full(-(-len(pick) // w) * w, _U(2**64 - 1))
        pad[: len(pick)] = pick
        box = pad.reshape(-1, w)
        ahead = np.minimum.accumulate(box, axis=1).ravel()
        behind = np.minimum.accumulate(box[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        cuts = np.flatnonzero(np.diff(least)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]]) - 1
        at = (least[starts] & _U(0xFFFFFFFF)).astype(np.int64)
        found.append((starts + a, ends + a, at + a, grams[at]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)


# --- the suffix sort -------------------------------------------------------------------------------------------


def common_extension(h: Hashes, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Longest common extension of the suffixes at x and y, up to ``most``: binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
    for _ in range(most.bit_length()):
        mid = (low + high + 1) >> 1
        same = h.of(x, mid) == h.of(y, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sort_suffixes(data: np.ndarray, h: Hashes, at: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes at ``at`` by (group, first ``length`` bytes, rank): a mergesort inside each group.

    ``group`` must be ascending. In each round every element finds its place among its sibling run by binary search.
    """
    n = len(at)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    order, width = np.arange(n), 1
    where = np.arange(n) - first  # place within the group

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ext = common_extension(h, at[x], at[y], length)
        step = np.minimum(ext, length - 1)
        bx, by = data[at[x] + step], data[at[y] + step]
        return np.where(ext >= length, rank[x] < rank[y], bx < by)

    while n and width < sizes.max():
        live = np.flatnonzero(size > width)
        run = where[live] // width
        other = (run ^ 1) * width
        many = np.clip(size[live] - other, 0, width)
        begin, own = first[live] + other, order[live]
        low, high = np.zeros(len(live), np.int64), many.copy()
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) >> 1
            smaller = less(order[begin[open_] + mid], own[open_])
            low[open_], high[open_] = np.where(smaller, mid + 1, low[open_]), np.where(smaller, high[open_], mid)
        to = first[live] + (run >> 1) * 2 * width + (where[live] % width) + low
        placed = order.copy()
        placed[to] = own
        order, width = placed, width * 2
    return order


def repeated(data: np.ndarray, at: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """True for each suffix whose first ``length`` bytes belong to a smaller rank of its group as well."""
    h, out = Hashes(data), np.zeros(len(at), bool)
    by = np.argsort(group, kind="stable")
    g = group[by]
    alone = np.ones(len(g), bool)
    if len(g):
        same = g[1:] == g[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
    by = by[~alone]
    order = by[sort_suffixes(data, h, at[by], group[by], rank[by], length)]
    x, y = order[:-1], order[1:]
    claim = np.flatnonzero((group[x] == group[y]) & (h.of(at[x], length) == h.of(at[y], length)))
    step = np.arange(length)
    for i in range(0, len(claim), 1 << 14):  # verified byte by byte
        c = claim[i : i + (1 << 14)]
        equal = (data[at[x[c], None] + step] == data[at[y[c], None] + step]).all(1)
        out[y[c[equal]]] = True
        for bad in c[~equal]:  # a hash collision: settle its group on the bytes themselves
            seen: dict[bytes, int] = {}
            members = np.flatnonzero(group == group[x[bad]])
            for m in members[np.argsort(rank[members])]:
                key = data[at[m] : at[m] + length].tobytes()
                out[m] = key in seen
                seen.setdefault(key, m)
    return out


# --- the Spark job ---------------------------------------------------------------------------------------------

_RUNS = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("lead", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
_RUNS_SQL = "key long, block long, row int, doc_id long, pos long, lead int, n int, data binary"
_CUTS_SQL = "block long, cuts binary"


def _merge(spans: np.ndarray) -> np.ndarray:
    """Union of (row, start, end) spans, sorted; touching spans become one."""
    if not len(spans):
        return spans.reshape(0, 3)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    shift = spans[:, 0] * (int(spans[:, 2].max()) + 1)
    end = np.maximum.accumulate(spans[:, 2] + shift) - shift
    new = np.ones(len(spans), bool)
    new[1:] = (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] > end[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], spans[first, 1], end[np.append(first[1:], len(spans)) - 1]], 1)


def _ask(length: int, gram: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        _, texts = in_order(table)
        found = [runs(np.frombuffer(t, np.uint8), length, gram)[3] for t in texts if len(t) >= length]
        keys, counts = np.unique(np.concatenate(found or [np.zeros(0, _U)]), return_counts=True)
        return requests(table["block"][0].as_py(), keys, counts, parts)

    return run


def _send(length: int, gram: int, hot: int):
    """Runs whose anchor is not unique; what the block itself has already shown earlier becomes a cut (key null)."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        block = docs["block"][0].as_py() if len(docs) else told["block"][0].as_py()
        ids, texts = in_order(docs)
        mine = [runs(np.frombuffer(t, np.uint8), length, gram) if len(t) >= length else None for t in texts]
        keys = np.unique(np.concatenate([m[3] for m in mine if m is not None] or [np.zeros(0, _U)]))
        count = totals(told)
        seen: set[bytes] = set()
        single: set[bytes] = set()
        rows, spans = [], []
        for row, (doc_id, text, m) in enumerate(zip(ids, texts, mine)):
            if m is None:
                continue
            times = count[np.searchsorted(keys, m[3])]
            for i in np.flatnonzero(times > 1).tolist():
                s, e, a = int(m[0][i]), int(m[1][i]), int(m[2][i])
                data = text[s : e + length]
                if data in seen:
                    spans.append((row, s, e + length))
                    continue
                seen.add(data)
                if times[i] <= hot:
                    rows.append((int(m[3][i].view(np.int64)), block, row, doc_id, s, a - s, e - s + 1, data))
                    continue
                own = mixed(Hashes(np.frombuffer(data, np.uint8)).of(np.arange(e - s + 1), length)) ^ m[3][i]
                for j in range(e - s + 1):
                    one = data[j : j + length]
                    if one in single:
                        spans.append((row, s + j, s + j + length))
                    else:
                        single.add(one)
                        rows.append((int(own[j].view(np.int64)), block, row, doc_id, s + j, a - s - j, 1, one))
        cuts = _merge(np.array(spans, np.int64).reshape(-1, 3)).astype("<i8")
        if len(cuts):
            rows.append((None, block, None, None, None, None, None, cuts.tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_RUNS), _RUNS)], schema=_RUNS)

    return run


def _sort(length: int):
    """Sorted partitions of runs in, (block, cuts) out; whole keys at a time."""

    def settle(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        block, row, pos, n, lead = (t[c].to_numpy() for c in ("block", "row", "pos", "n", "lead"))
        blob = t["data"].combine_chunks()
        blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
        texts = blob.to_pylist()
        data = np.frombuffer(b"".join(texts), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(x) for x in texts])[:-1]]).astype(np.int64)
        # order of runs: by document (null last), then its block's order, then position; blocks keep an id together
        ids = t["doc_id"]
        void = ids.is_null().to_numpy()
        doc = ids.fill_null(0).to_numpy()
        order = np.lexsort((pos, row, block, doc, void))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # equal runs: all windows but those of the first are repeated; what is left is sorted
        first: set[bytes] = set()
        whole = np.zeros(len(n), bool)
        for i in order.tolist():
            whole[i] = texts[i] in first
            first.add(texts[i])
        _, code = np.unique(t["key"].to_numpy(), return_inverse=True)
        some = np.flatnonzero(~whole & (np.bincount(code[~whole], minlength=len(code))[code] > 1))
        run = np.repeat(some, n[some])
        n_some = n[some]
        j = np.arange(len(run)) - np.repeat(np.cumsum(n_some) - n_some, n_some)
        offset = lead[run] - j  # of the anchor in the window: equal windows have equal ones
        group = code[run].astype(np.int64) * (2 * length) + offset
        gone = repeated(data, base[run] + j, group, place[run] * np.int64(1 << 16) + j, length)
        r, k, w = run[gone], j[gone], np.flatnonzero(whole)
        spans = np.concatenate([np.stack([row[r], pos[r] + k, pos[r] + k + length], 1), np.stack([row[w], pos[w], pos[w] + n[w] - 1 + length], 1)])
        return block[np.concatenate([r, w])], spans.astype(np.int64)

    def packed(block: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(block, kind="stable")
        block, spans = block[order], spans[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1]) if len(block) else np.zeros(0, np.int64)
        cuts = [_merge(x).astype("<i8").tobytes() for x in np.split(spans, first[1:])] if len(block) else []
        return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int64()), pa.array(cuts, pa.binary())], names=["block", "cuts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            done = b.filter(b.column("key").is_null())
            if len(done):
                yield pa.RecordBatch.from_arrays([done.column("block"), done.column("data")], names=["block", "cuts"])
            b = b.filter(b.column("key").is_valid())
            if not len(b):
                continue
            held.append(b)
            size += b.nbytes
            if size > 2 << 20:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t["key"].to_numpy()
                end = int(np.searchsorted(key, key[-1]))
                if end:
                    yield packed(*settle(t.slice(0, end)))
                held = t.slice(end).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held) if end else 0
        if held:
            yield packed(*settle(pa.Table.from_batches(held)))

    return run


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = 32, block_bytes: int = 2 << 20, hot: int = 16_384, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(blocks, cuts): the documents in blocks, and (block, cuts) with packed (row, start, end) spans to remove."""
    n = text_size(docs)
    blocks = blocked(docs, block_bytes, carry)
    told = answers(blocks.groupBy("block").applyInArrow(_ask(length, gram, lookup_parts(n)), ASK))
    sent = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send(length, gram, hot), _RUNS_SQL)
    salt = F.coalesce("key", F.xxhash64("block"))
    cuts = sent.repartition(salt).sortWithinPartitions(F.col("key").asc_nulls_first()).mapInArrow(_sort(length), _CUTS_SQL)
    return blocks, cuts


def _spans_by_row(cuts: pa.Table) -> dict[int, list[tuple[int, int]]]:
    spans = _merge(np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 3) for x in cuts["cuts"].to_pylist()] or [np.zeros((0, 3), np.int64)]))
    out: dict[int, list[tuple[int, int]]] = {}
    for row, s, e in spans.tolist():
        out.setdefault(row, []).append((s, e))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def dedup(docs: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, *carry): what is left of every text as bytes.

    Removed is each byte covered by a ``length``-byte string that also starts earlier: in a smaller id, or earlier in
    the same text. Null and empty texts have nothing to remove. A null id comes last; rows that share an id are
    ordered by their texts, so of two equal rows one is removed whole. An empty table gives an empty result.
    """
    blocks, cuts = repeated_spans(docs, carry=carry, **options)

    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts = in_order(mine)
        spans, mine = _spans_by_row(found), ordered(mine)
        left = [_kept(t, spans.get(i, [])) for i, t in enumerate(texts)]
        cols = [ids, [len(t) for t in texts], [len(t) - len(k) for t, k in zip(texts, left)], [len(spans.get(i, [])) for i in range(len(texts))], left]
        columns = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.table([*columns, *[mine[c] for c in carry]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return blocks.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(run, schema)


def as_text(left: DataFrame) -> DataFrame:
    """``left`` with ``text`` for ``kept``: what is left, without bytes that no longer make a character."""
    names = [c for c in left.columns if c not in ("kept", "text")]

    def run(batches):
        for b in batches:
            texts = pa.array([x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], texts], names=[*names, "text"])

    schema = ", ".join([f"`{c}` {left.schema[c].dataType.simpleString()}" for c in names] + ["text string"])
    return left.select(*names, "kept").mapInArrow(run, schema)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
