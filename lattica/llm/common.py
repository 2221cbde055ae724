"""What the operators of this subpackage share: shipping, checkpoints, blocks of documents and packed look-ups.

A *block* is a set of whole documents, dealt by a hash of the document id, of about ``block_bytes`` of text.
Operators that need a statistic of the whole corpus for every token of a text work in two steps: every block
asks for its distinct keys once (so a key that fills a third of the corpus costs one request a block), the
table of keys is partitioned by hash, and the answers return to the block that asked.
"""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the ASCII space and 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
_SHIPPED: set[str] = set()
#: Bytes of a batch of rows on its way to a Python worker: whole texts would fill some 20 MB, in each of several buffers.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a session, so that workers import it from any folder, and keep what goes to
    workers at once small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="lattica-"), "lattica_ship.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "lattica")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. Only a local session may have one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lattica-ckpt-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there; lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_size(df: DataFrame, text_col: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0)


def blocked(df: DataFrame, block_bytes: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, doc_id, text, *carry) dealt into blocks of about ``block_bytes``; null texts become empty.

    All rows of one id share a block. Plans that use the frame twice reuse its one exchange.
    """
    n = max(1, math.ceil(text_size(df) / block_bytes))
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.pmod(F.xxhash64(doc), F.lit(n)).alias("block"), doc.alias("doc_id"), text.alias("text"), *carry).repartition("block")


def ordered(table: pa.Table) -> pa.Table:
    """A block in its fixed order: by id (null last), then text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def in_order(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and UTF-8 texts of a block in its fixed order."""
    table = ordered(table)
    return table["doc_id"].to_pylist(), table["text"].cast(pa.binary()).to_pylist()


def releasing(run):
    """``run`` over a task's batches; afterwards the worker, which Spark keeps, hands free memory back to the system."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


# --- packed look-ups -------------------------------------------------------------------------------------------

ASK = "part int, block long, keys binary, counts binary"
ANSWER = "block long, part int, totals binary"


def _pack(counts: np.ndarray) -> bytes:
    """Counts are mostly small: packed, they take a fraction of what the keys take. The first byte is their width."""
    width = 4 if not len(counts) or int(counts.max()) < 1 << 32 else 8
    return bytes((width,)) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def requests(block: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """A block's distinct keys (sorted uint64) with their counts, cut at the borders of the hash partitions."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    rows = [(int(part[s]), int(block), keys[s:e].tobytes(), _pack(counts[s:e])) for s, e in zip(starts, ends) if e > s]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "block", "keys", "counts"])


def _total(table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x, "<u8") for x in table["keys"].to_pylist()]
    counts = [_unpack(x) for x in table["counts"].to_pylist()]
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(int(where.max()) + 1 if len(where) else 0, np.int64)
    np.add.at(sums, where, np.concatenate(counts))  # whole numbers of 64 bits: no cap, no rounding
    found = sums[where]
    ends = np.cumsum([len(k) for k in keys])
    return pa.table(
        [table["block"], table["part"], pa.array([_pack(found[e - len(k) : e]) for k, e in zip(keys, ends)], pa.binary())], names=["block", "part", "totals"]
    )


def answers(asked: DataFrame) -> DataFrame:
    """The count table, partitioned by hash, joined to what the blocks asked: totals in the order of the request."""
    return asked.groupBy("part").applyInArrow(_total, ANSWER)


def totals(table: pa.Table) -> np.ndarray:
    """The answers of one block as counts of its sorted keys."""
    table = table.sort_by("part")
    return np.concatenate([_unpack(x) for x in table["totals"].to_pylist()] or [np.zeros(0, np.int64)])


def lookup_parts(n_bytes: int, part_bytes: int = 16 << 20) -> int:
    """Hash partitions of a look-up: in proportion to the corpus, so that each stays small."""
    return max(12, math.ceil(n_bytes / part_bytes))
