"""Token ids in files of independently coded blocks: a static range asymmetric numeral system.

One frequency table, counted over the whole corpus and scaled to 2^20, is shared by all blocks. A block has 2^14 ids
dealt to 64 interleaved lanes; its checkpoint (the lanes' states and its offset into the payload) lets it be decoded
alone, and its CRC-32 is checked when it is. Blocks lie in frames of whole documents; a frame is one row of a Parquet
table with its documents' ids, lengths and first position in the corpus, so any reader can decode any frame alone.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import shared_folder
from lattica.llm.pretokens import Library, Memo, batches_of, tokenizer_path

SCALE, BLOCK, LANES = 20, 1 << 14, 64
STEPS, LOW = BLOCK // LANES, np.uint64(1 << 31)
#: Ids after which a frame ends with the document at hand.
FRAME = 1 << 20
_U = np.uint64


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies with sum 2^SCALE, at least 1 for every symbol that occurs."""
    total = 1 << SCALE
    freq = np.where(counts > 0, np.maximum(1, counts * total // max(1, int(counts.sum()))), 0).astype(np.int64)
    over = int(freq.sum()) - total
    if not freq.any():
        return freq
    for i in np.argsort(-freq, kind="stable"):  # the commonest symbols take up what rounding left
        step = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= step
        over -= step
        if over <= 0:
            break
    return freq


class Coder:
    """Encodes and decodes id arrays under one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(_U)
        self.cum = (np.cumsum(freq) - freq).astype(_U)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, list[int], list[int]]:
        """(payload words, checkpoint states, words of each block, CRC-32 of each block's ids)."""
        n = len(ids)
        blocks = -(-n // BLOCK)
        if not blocks:
            return b"", b"", [], []
        pad = np.zeros(blocks * BLOCK, np.int64)
        pad[:n] = ids
        sym = np.ascontiguousarray(pad.reshape(blocks, STEPS, LANES).transpose(1, 0, 2)).reshape(STEPS, -1)
        live = np.ascontiguousarray((np.arange(blocks * BLOCK) < n).reshape(blocks, STEPS, LANES).transpose(1, 0, 2)).reshape(STEPS, -1)
        words, out = np.zeros(sym.shape, np.uint32), np.zeros(sym.shape, bool)
        x = np.full(sym.shape[1], LOW, _U)
        for s in range(STEPS - 1, -1, -1):
            f, c, on = self.freq[sym[s]], self.cum[sym[s]], live[s]
            f = np.where(on, f, _U(1))
            spill = (x >= (f << _U(63 - SCALE))) & on
            words[s], out[s] = x.astype(np.uint32), spill
            x0 = np.where(spill, x >> _U(32), x)
            q = x0 // f
            x = np.where(on, (q << _U(SCALE)) + (x0 - q * f) + c, x)
        words, out = words.reshape(STEPS, blocks, LANES).transpose(1, 0, 2), out.reshape(STEPS, blocks, LANES).transpose(1, 0, 2)
        parts = [words[b][out[b]] for b in range(blocks)]
        raw = ids.astype("<u4")
        sums = [zlib.crc32(raw[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(blocks)]
        return np.concatenate(parts).astype("<u4").tobytes(), x.astype("<u8").tobytes(), [len(p) for p in parts], sums

    def decode(self, payload: bytes, states: bytes, lengths: list[int], sums: list[int], n: int) -> np.ndarray:
        """The ids; raises ValueError if a block's checksum does not hold."""
        blocks = len(lengths)
        if not blocks:
            return np.zeros(0, "<u4")
        words = np.append(np.frombuffer(payload, "<u4"), np.uint32(0)).astype(_U)
        at = (np.cumsum(lengths) - np.array(lengths))[:, None]
        x = np.frombuffer(states, "<u8").astype(_U)
        sym = np.empty((STEPS, blocks * LANES), np.uint32)
        whole = n == blocks * BLOCK
        live = None if whole else np.ascontiguousarray((np.arange(blocks * BLOCK) < n).reshape(blocks, STEPS, LANES).transpose(1, 0, 2)).reshape(STEPS, -1)
        mask = _U((1 << SCALE) - 1)
        for s in range(STEPS):
            slot = x & mask
            t = sym[s] = self.symbol[slot]
            y = self.freq[t] * (x >> _U(SCALE)) + slot - self.cum[t]
            if not whole:
                y = np.where(live[s], y, x)
            need = (y < LOW).reshape(blocks, LANES)
            took = np.cumsum(need, 1)
            where = np.minimum(at + took - need, len(words) - 1).ravel()
            x = np.where(need.ravel(), (y << _U(32)) | words[where], y)
            at = at + took[:, -1:]
        ids = sym.reshape(STEPS, blocks, LANES).transpose(1, 0, 2).reshape(-1)[:n].astype("<u4")
        for b, want in enumerate(sums):
            if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].tobytes()) != want:
                raise ValueError(f"checksum of block {b} does not hold")
        return ids


_FRAMES = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("ids", pa.binary()), ("used", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
_FRAMES_SQL = "shard int, frame int, start long, n long, doc_ids array<long>, doc_lens array<long>, ids binary, used array<int>, counts array<long>"
_CODED = pa.schema([*list(_FRAMES)[:-3], ("payload", pa.binary()), ("states", pa.binary()), ("lengths", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
_CODED_SQL = _FRAMES_SQL.replace("ids binary, used array<int>, counts array<long>", "payload binary, states binary, lengths array<long>, sums array<long>")
_WORKER: dict[str, Memo] = {}


def _memo(path: str) -> Memo:
    if path not in _WORKER:
        _WORKER[path] = Library(path).memo()
    return _WORKER[path]


def _frames(path: str, end_id: int, kind: str, size: int):
    """Tokenised frames of one range of ids, in order, and after them a row with the range's id counts; the range's
    number is the task's."""

    def run(batches):
        shard, frame, start, n = TaskContext.get().partitionId(), 0, 0, 0
        docs: list = []
        lens: list[int] = []
        held: list[bytes] = []
        total = np.zeros(size, np.int64)
        tail = np.array([end_id], "<u4").tobytes()

        def row(*cols):
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cols, _FRAMES)], schema=_FRAMES)

        def flush():
            nonlocal frame, start, docs, lens, held, n, total
            ids = np.frombuffer(b"".join(held), "<u4")
            total += np.bincount(ids, minlength=size)
            out = row(shard, frame, start, n, docs, lens, ids.astype(kind).tobytes(), None, None)
            frame, start, docs, lens, held, n = frame + 1, start + n, [], [], [], 0
            return out

        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for s, e in batches_of(texts):
                for i, raw in zip(ids[s:e], _memo(path).ids(texts[s:e])):
                    docs.append(i)
                    lens.append(len(raw) // 4 + 1)
                    held += [raw, tail]
                    n += lens[-1]
                    if n >= FRAME:
                        yield flush()
        if docs:
            yield flush()
        if frame:
            used = np.flatnonzero(total)
            yield row(shard, -1, 0, start, [], [], None, used, total[used])

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> None:
    """Tokenise every text of ``docs`` (doc_id, text; null: empty) and write ``folder``/frames and /frequencies.

    Documents lie in ascending order of id, null ids last, rows of one id by their texts; every document ends with
    ``end_id``. An empty table gives tables without rows.
    """
    spark = docs.sparkSession
    size = max(Library(path).size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    key = F.col("doc_id").asc_nulls_last()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartitionByRange(key).sortWithinPartitions(key, "text")
    ordered.mapInArrow(_frames(path, end_id, kind, size), _FRAMES_SQL).write.option("compression", "zstd").parquet(f"{folder}/ids")
    plain = spark.read.parquet(f"{folder}/ids")
    told, frames = plain.where("frame < 0"), plain.where("frame >= 0")
    counts = np.zeros(size, np.int64)
    for r in told.select(F.explode(F.map_from_arrays("used", "counts")).alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row an id of the vocabulary
        counts[r["id"]] = r["n"]
    freq = quantise(counts)
    before, at = {}, 0
    for r in told.select("shard", "n").orderBy("shard").collect():  # one row a range of documents
        before[r["shard"]], at = at, at + r["n"]

    def code(batches):
        coder = Coder(freq)
        for b in batches:
            for r in b.to_pylist():
                done = coder.encode(np.frombuffer(r["ids"], kind))
                cols = [[r["shard"]], [r["frame"]], [before[r["shard"]] + r["start"]], [r["n"]], [r["doc_ids"]], [r["doc_lens"]], *[[x] for x in done]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CODED)], schema=_CODED)

    frames.drop("used", "counts").mapInArrow(code, _CODED_SQL).write.parquet(f"{folder}/frames")
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in used], "id int, frequency int").coalesce(1).write.parquet(f"{folder}/frequencies")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) decoded from the files, a frame at a time; blocks are checked."""
    table = spark.read.parquet(f"{folder}/frequencies").collect()
    freq = np.zeros(max([r["id"] for r in table], default=0) + 1, np.int64)
    for r in table:
        freq[r["id"]] = r["frequency"]

    def run(batches):
        coder = Coder(freq)
        for b in batches:
            for r in b.to_pylist():
                ids = coder.decode(r["payload"], r["states"], r["lengths"], r["sums"], r["n"])
                ends = np.cumsum(r["doc_lens"])
                starts = ends - r["doc_lens"]
                parts = [ids[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"], pa.int64()), pa.array(r["doc_lens"], pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{folder}/frames").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_file(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path("byte_bpe_50k.json"))
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
