"""Token counts without token ids: pieces of each distinct pre-token, joined to the documents' pre-token frequencies.

Tasks read documents in blocks and keep, for each block, its distinct pre-tokens and a sparse matrix of the documents'
frequencies. Equal pre-tokens of all blocks meet in one task, which counts the pieces of each once; the counts return
to the blocks' matrices and are weighted and summed. Texts are never shuffled, and a pre-token that every document
holds is one row a block. Both uses of the blocks read the input alike; a block is named by a hash of its pre-tokens,
so an input that came out differently the second time is an error and never a wrong count.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.pretokens import Library, pretokens, tokenizer_path

_TOOLS: dict[str, Library] = {}


def _tool(path: str) -> Library:
    if path not in _TOOLS:
        _TOOLS[path] = Library(path)
    return _TOOLS[path]


class _Block:
    """Distinct pre-tokens of some documents, numbered as they come, and the documents' frequencies."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.doc_ids: list = []
        self.sizes: list[int] = []
        self.specials: list[int] = []
        self.ends: list[int] = []
        self.idx: list[np.ndarray] = []
        self.cnt: list[np.ndarray] = []
        self.bytes = self.pairs = 0

    def add(self, doc_id, text: str, special: str) -> None:
        parts = text.split(special)
        c: Counter = Counter(pretokens(parts[0]))
        for p in parts[1:]:
            c.update(pretokens(p))
        number = self.number
        for t in c:
            if t not in number:
                number[t] = len(number)
        self.idx.append(np.fromiter(map(number.__getitem__, c), np.uint32, len(c)))
        self.cnt.append(np.fromiter(c.values(), np.uint32, len(c)))
        self.pairs += len(c)
        self.doc_ids.append(doc_id)
        self.specials.append(len(parts) - 1)
        self.ends.append(self.pairs)
        size = len(text.encode())
        self.sizes.append(size)
        self.bytes += size

    def name(self, task: int, seq: int) -> int:
        h = xxhash.xxh64(f"{task}:{seq}".encode())
        for t in self.number:
            h.update(t)
        return int(np.uint64(h.intdigest()).view(np.int64))


def _blocks(special: str, block_bytes: int, out):
    """A mapInArrow function: ``out(name, block)`` gives the batches of each block of about ``block_bytes`` of text."""

    def run(batches):
        task, seq, block = TaskContext.get().partitionId(), 0, _Block()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                block.add(doc_id, text or "", special)
                if block.bytes >= block_bytes:
                    yield from out(block.name(task, seq), block)
                    seq, block = seq + 1, _Block()
        if block.doc_ids:
            yield from out(block.name(task, seq), block)

    return run


def _asked(name: int, block: _Block):
    words = list(block.number)
    for i in range(0, len(words), 50_000):
        part = words[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part, pa.string())], names=["block", "idx", "token"])


def _packed(x, kind: str) -> bytes:
    return zlib.compress(np.asarray(x, kind).tobytes(), 1)


def _matrix(name: int, block: _Block):
    cols = [[name], [len(block.number)], [block.doc_ids], [block.sizes], [block.specials], [block.ends], [_packed(np.concatenate(block.idx), "<u4")], [_packed(np.concatenate(block.cnt), "<u4")]]
    types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["block", "n_words", "doc_ids", "sizes", "specials", "ends", "idx", "cnt"])


_MATRIX_SQL = "block long, n_words int, doc_ids array<long>, sizes array<long>, specials array<long>, ends array<long>, idx binary, cnt binary"


def _pieces(path: str):
    """Sorted (block, idx, token) in, (block, idx, n) out: each token is encoded once, also across batches."""

    def run(batches):
        last: dict[str, int] = {}
        for b in batches:
            tokens = b.column("token").to_pylist()
            new = [t for t in dict.fromkeys(tokens) if t not in last]
            found = last | {t: len(_tool(path).encode(t)) for t in new}
            n = pa.array(np.fromiter(map(found.__getitem__, tokens), np.int32, len(tokens)))
            last = {tokens[-1]: found[tokens[-1]]} if tokens else last
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("idx"), n], names=["block", "idx", "n"])

    return run


def _weigh(matrix: pa.Table, told: pa.Table) -> pa.Table:
    out = []
    for r in matrix.to_pylist():  # one row, but for a block that two tasks hold alike
        if len(told) != r["n_words"] * len(matrix):
            raise RuntimeError("the documents changed while their tokens were counted")
        n = np.zeros(r["n_words"], np.int64)
        n[told["idx"].to_numpy()] = told["n"].to_numpy()
        idx, cnt = (np.frombuffer(zlib.decompress(r[c]), "<u4") for c in ("idx", "cnt"))
        upto = np.concatenate([[0], np.cumsum(cnt * n[idx])]).astype(np.int64)
        ends = np.array(r["ends"], np.int64)
        total = upto[ends] - upto[np.concatenate([[0], ends[:-1]])] + np.array(r["specials"], np.int64)
        out.append(pa.table([pa.array(r["doc_ids"], pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"]))
    if not out:
        raise RuntimeError("the documents changed while their tokens were counted")
    return pa.concat_tables(out)


def count_tokens(docs: DataFrame, path: str, special: str = "<|endoftext|>", block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) under the byte-level tokenizer at ``path``; ``special`` in a text is one token.

    One row for every row of ``docs``: repeated ids and null ids keep theirs. Null and empty texts have no tokens. An
    empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = docs.mapInArrow(_blocks(special, block_bytes, _asked), "block long, idx int, token string")
    told = asked.repartition("token").sortWithinPartitions("token").mapInArrow(_pieces(path), "block long, idx int, n int")
    matrix = docs.mapInArrow(_blocks(special, block_bytes, _matrix), _MATRIX_SQL)
    return matrix.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_weigh, "doc_id long, n_bytes long, n_tokens long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", found["n_tokens"] > 1024)
