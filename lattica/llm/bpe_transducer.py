"""Byte-level BPE as a lazily determinised finite-state transducer, and incremental UTF-8 decoding.

The BPE tokens of a prefix end in exactly one token, and a token sequence is the encoding of its bytes exactly if every
two neighbours are the encoding of theirs. So while reading bytes it is enough to follow, for every place where a
token may still be open, the bytes since and the token before. These sets are the states of a deterministic
transducer, built only as texts visit them; each arc is labelled with the token that ends there. A start drops out once
no token goes on from it, at the latest after the longest token's length, which bounds the lookahead: the labels lead
back from every open start, and what lies before the place where these ways meet is settled. It is emitted every
``SETTLE`` bytes and its labels are dropped.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from lattica.llm.common import releasing
from lattica.llm.pretokens import Memo, batches_of, pretokens, tokenizer_path

#: Bytes read between two looks for settled tokens.
SETTLE = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_NEVER = 1 << 60
#: The bits of a start that name its node.
_NODE = (1 << 32) - 1


def merge(piece: bytes, ranks: dict[bytes, int], below: int = _NEVER) -> list[int]:
    """The definition: join the neighbours of lowest rank, the first of equals, until none can be joined ``below`` a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    cost = [ranks.get(piece[i : i + 2], _NEVER) for i in range(len(piece) - 1)]
    while cost:
        least = min(cost)
        if least >= below:
            break
        i = cost.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del cost[i]
        if i:
            cost[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
        if i < len(cost):
            cost[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
    return [ranks[p] for p in parts]


class Transducer:
    """``encode(piece)`` gives the ids of one pre-token; states and fitting pairs are remembered up to ``limit``.

    A state holds each start of a token that may still be open: its bytes so far, as a node of the tree of all tokens, and
    the token before it, both in one number. An arc's label is the token in which the bytes read so far end.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = 100_000):
        self.ranks, self.limit = ranks, limit
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size_of = {v: len(k) for k, v in ranks.items()}
        self._grow_tree()
        self.halves: dict[int, tuple[bytes, int, bytes, int] | tuple[()]] = {}
        self._reset()

    def _reset(self) -> None:
        """Back to the first state: states are built again as texts visit them."""
        self.fits: dict[int, bool] = {}  # token before + 1 << 32 | token
        self.number: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []  # of token before + 1 << 32 | node, longest start first
        self.arcs: dict[int, int] = {}  # state * 256 + byte -> (next state * 256) << 24 | label
        self._state((0,))

    def _grow_tree(self) -> None:
        """Nodes are the starts of tokens, 0 the empty one: what a byte leads to, the token that a node is (or -1), its
        length, and whether a longer token goes on from it."""
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token, self.depth, self.more = [-1], [0], [True]
        for k, v in self.ranks.items():
            node = 0
            for c in k:
                to = self.child.get(node << 8 | c)
                if to is None:
                    to = self.child[node << 8 | c] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.more.append(False)
                    self.more[node] = True
                node = to
            self.token[node] = v

    def _state(self, s: tuple[int, ...]) -> int:
        n = self.number.get(s)
        if n is None:
            n = self.number[s] = len(self.states)
            self.states.append(s)
        return n

    def _halves(self, t: int) -> tuple[bytes, int, bytes, int] | tuple[()]:
        """The two pieces that the last merge of token ``t`` joins, each with its rank (-1: a single byte); none if merges
        do not lead to it."""
        parts = merge(self.bytes_of[t], self.ranks, t)
        found = self.halves[t] = tuple(x for p in parts for x in (self.bytes_of[p], p if self.size_of[p] > 1 else -1)) if len(parts) == 2 else ()
        return found

    def _fit(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border between tokens ``a`` and ``b``: going back in time, merge by merge, no
        two pieces that meet there make a token that comes before the next merge on either side."""
        if a < 0:
            return True
        known = self.fits.get(a + 1 << 32 | b)
        if known is None:
            x, y, limit, rank_of, halves_of = self.bytes_of[a], self.bytes_of[b], _NEVER, self.ranks.get, self.halves.get
            s, t = a if len(x) > 1 else -1, b if len(y) > 1 else -1
            while True:
                if rank_of(x + y, _NEVER) < limit:
                    known = False
                    break
                if s == t == -1:
                    known = True
                    break
                last = s if s > t else t
                halves = halves_of(last)
                if not halves and not (halves := self._halves(last)):
                    known = merge(self.bytes_of[a] + self.bytes_of[b], self.ranks) == [a, b]
                    break
                if s > t:
                    limit, (_, _, x, s) = last, halves
                else:
                    limit, (y, t, _, _) = last + 1, halves
            self.fits[a + 1 << 32 | b] = known
        return known

    def _arc(self, s: int, c: int) -> int:
        out, label, child, token, more, fits = [], -1, self.child.get, self.token, self.more, self.fits.get
        for x in self.states[s]:
            node = child((x & _NODE) << 8 | c)
            if node is None:
                continue
            if label < 0 and (t := token[node]) >= 0:
                known = fits(x & ~_NODE | t)
                if self._fit((x >> 32) - 1, t) if known is None else known:
                    label = t
            if more[node]:
                out.append(x & ~_NODE | node)
        out.append(label + 1 << 32)
        arc = self.arcs[s << 8 | c] = self._state(tuple(out)) << 32 | label
        return arc

    def emit(self, labels: list[int]) -> list[int]:
        """The tokens that end where the labels (or their arcs) end, first to last."""
        out, at, size_of = [], len(labels), self.size_of
        while at:
            t = labels[at - 1] & 0xFFFFFF
            out.append(t)
            at -= size_of[t]
        return out[::-1]

    def settle(self, s: int, labels: list[int]) -> list[int]:
        """The tokens that no byte to come can change, taken off the front of ``labels``: those before the place where
        the ways back from all open starts of state ``s`` meet."""
        starts = {len(labels) - self.depth[x & _NODE] for x in self.states[s]}
        while len(starts) > 1:
            last = max(starts)
            starts.remove(last)
            starts.add(last - self.size_of[labels[last - 1]])
        at = starts.pop()
        out = self.emit(labels[:at])
        del labels[:at]
        return out

    def stream(self, piece: Iterable[int], held: list[int] | None = None) -> Iterator[int]:
        """Ids of one pre-token's bytes, each as soon as it is settled; ``held`` are the labels kept meanwhile."""
        s, labels = 0, [] if held is None else held
        for n, c in enumerate(piece, 1):
            arc = self.arcs.get(s | c) or self._arc(s >> 8, c)
            s = arc >> 24
            labels.append(arc & 0xFFFFFF)
            if n % SETTLE == 0:
                yield from self.settle(s >> 8, labels)
        yield from self.emit(labels)

    def encode(self, piece: bytes) -> list[int]:
        if len(self.fits) > self.limit:
            self.fits = {}
        if len(self.states) > self.limit:
            self._reset()
        if len(piece) >= SETTLE:
            return list(self.stream(piece))
        s, arcs, arc_of = 0, [], self.arcs.get  # too short to settle before its end
        for c in piece:
            arc = arc_of(s | c) or self._arc(s >> 8, c)
            s = arc >> 24
            arcs.append(arc)
        return self.emit(arcs)


class Decoder:
    """Token bytes fed through an incremental UTF-8 state machine: text comes out as soon as it is whole."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.table[v] = k

    def stream(self, ids: Iterable[int], step: int = 4096) -> Iterator[tuple[bytes, str]]:
        """(bytes, text) pieces; a sequence cut between tokens waits for its rest, a broken one becomes U+FFFD."""
        machine, ids, get = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids), self.table.__getitem__
        while part := list(islice(ids, step)):
            raw = b"".join(map(get, part))
            yield raw, machine.decode(raw)
        tail = machine.decode(b"", final=True)
        if tail:
            yield b"", tail


_WORKER: dict[str, tuple] = {}


def _tools(path: str):
    """Of this worker: the memo of pieces and the decoder for one vocabulary, and what empties the former."""
    if path not in _WORKER:
        ranks = load_ranks(path)
        machine = Transducer(ranks)
        memo = Memo(lambda text: [t for p in pretokens(text) for t in machine.encode(p.encode())], limit=120_000, single=lambda text: machine.encode(text.encode()))

        def forget() -> None:
            machine._reset()
            memo.forget()

        _WORKER[path] = memo, Decoder(ranks), forget
    return _WORKER[path]


def _forgetting(path: str, f):
    """``f`` over a task's batches; afterwards the worker, which Spark keeps, holds the vocabulary and nothing else."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _tools(path)[2]()

    return releasing(run)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``: little-endian unsigned 32-bit token ids of the whole text, special strings as plain text.

    Null and empty texts have no ids. Rows are independent, so repeated rows, null ids and other columns pass through
    (a column named ``ids`` is replaced); an empty table stays empty.
    """
    docs = docs.drop("ids")

    def run(batches):
        for b in batches:
            memo = _tools(path)[0]
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            ids: list[bytes] = []
            for s, e in batches_of(texts):
                ids += memo.ids(texts[s:e])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(_forgetting(path, run), StructType([*docs.schema.fields, StructField("ids", BinaryType())]))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (the text) and ``decoded_sha256`` (of the decoded bytes) from the column ``ids``."""
    encoded = encoded.drop("decoded", "decoded_sha256")

    def run(batches):
        for b in batches:
            decoder = _tools(path)[1]
            texts, shas = [], []
            for raw in b.column("ids").to_pylist():
                sha, text = hashlib.sha256(), []
                for part, s in decoder.stream(np.frombuffer(raw or b"", "<u4").tolist()):
                    sha.update(part)
                    text.append(s)
                texts.append("".join(text))
                shas.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(shas)], names=[*b.schema.names, "decoded", "decoded_sha256"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType()), StructField("decoded_sha256", StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` and the SHA-256 of what they decode to.

    The same as encoding and then decoding, in one worker a task, so that no worker holds a second vocabulary. Null and
    empty texts have no ids; repeated rows, null ids, empty tables and other columns are as there.
    """
    docs = docs.drop("ids", "decoded_sha256")
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in batches:
            memo, decoder, _ = _tools(path)
            texts = [t or "" for t in b.column("text").to_pylist()]
            for s, e in batches_of(texts):
                ids, shas = memo.ids(texts[s:e]), []
                for raw in ids:
                    sha = hashlib.sha256()
                    for part, _ in decoder.stream(np.frombuffer(raw, "<u4").tolist()):
                        sha.update(part)
                    shas.append(sha.hexdigest())
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(s, e - s) for c in names], pa.array(ids, pa.binary()), pa.array(shas)], names=[*names, "ids", "decoded_sha256"])

    fields = [docs.schema[c] for c in names]
    return docs.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(_forgetting(path, run), StructType([*fields, StructField("ids", BinaryType()), StructField("decoded_sha256", StringType())]))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    done = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
