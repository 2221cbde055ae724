"""Baseline JPEG media columns: markers, Huffman scans and DC-only luminance thumbnails, in numpy.

The decoder works on many images at once: every restart interval is a lane, and each step decodes one symbol of every
lane. The encoder writes grey images whose 8x8 blocks are flat: with a DC quantiser of 8 a block's value is its DC
coefficient, so an image's DC-only thumbnail is exactly the bytes that were stored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks in a row of a stored image, rows of one image at most, blocks between restart markers.
ROW, MOST_ROWS, RESTART = 24, 8184, 64
#: Code lengths of the common luminance DC table (its symbols are 0 to 11), and one AC code: end of block.
DC_BITS, AC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
_END = re.compile(rb"\xff(?![\x00\xd0-\xd7\xff])")
_U = np.uint64


def codes(bits, symbols) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + bytes([8]) + bytes([1] * 63))
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(range(12)))
        + _segment(0xC4, b"\x10" + bytes(AC_BITS) + b"\x00")
        + _segment(0xDD, struct.pack(">H", RESTART))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


_DC = {s: (c, n) for s, c, n in codes(DC_BITS, range(12))}
_SIZE = np.array([i.bit_length() for i in range(512)])
_CODE, _LEN = np.array([_DC[s][0] for s in range(12)]), np.array([_DC[s][1] for s in range(12)])


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of ``ROW`` bytes) as one or more grey images, one after the other."""
    frames, owner = [], []
    for i, p in enumerate(payloads):
        for s in range(0, len(p), ROW * MOST_ROWS):
            frames.append(p[s : s + ROW * MOST_ROWS])
            owner.append(i)
    sizes = np.array([len(f) for f in frames], np.int64)
    data = np.frombuffer(b"".join(frames), np.uint8).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    inside = np.arange(len(data)) - np.repeat(first, sizes)
    opens = inside % RESTART == 0
    dc = data - 128
    diff = dc.copy()
    diff[1:] -= dc[:-1]
    diff[opens] = dc[opens]
    size = _SIZE[np.abs(diff)]
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code, length = ((_CODE[size] << size) | bits) << 1, _LEN[size] + size + 1  # the last 0 ends the block
    seg = np.flatnonzero(opens)
    upto = np.cumsum(length) - length
    n_bits = np.add.reduceat(length, seg)
    n_bytes = (n_bits + 7) >> 3
    seg_byte = np.cumsum(n_bytes) - n_bytes
    per = np.diff(np.append(seg, len(data)))
    at = upto - np.repeat(upto[seg] - seg_byte * 8, per)
    total = int(n_bytes.sum())
    wide = code << (24 - (at & 7) - length)
    raw = np.zeros(total + 2)
    for k in range(3):
        raw += np.bincount((at >> 3) + k, weights=(wide >> (16 - 8 * k)) & 255, minlength=total + 2)[: total + 2]
    raw = raw[:total].astype(np.int64)
    last = seg_byte + n_bytes - 1
    raw[last] |= (1 << (n_bytes * 8 - n_bits)) - 1
    # stuffing, and a restart marker after each interval but an image's last
    number = inside[seg] // RESTART
    final = np.append(number[1:] == 0, True)
    stuffed = raw == 255
    extra = stuffed.astype(np.int64)
    extra[last[~final]] += 2
    place = np.arange(total) + np.cumsum(extra) - extra
    out = np.zeros(total + int(extra.sum()), np.uint8)
    out[place] = raw
    mark = place[last[~final]] + 1 + stuffed[last[~final]]
    out[mark], out[mark + 1] = 255, 0xD0 + number[~final] % 8
    starts = place[seg_byte[number == 0]]
    blob, ends = out.tobytes(), np.append(starts[1:], len(out)).tolist()
    media: list[list[bytes]] = [[] for _ in payloads]
    for i, n, s, e in zip(owner, sizes.tolist(), starts.tolist(), ends):
        media[i] += [_header(n // ROW), blob[s:e], b"\xff\xd9"]
    return [b"".join(m) for m in media]


# --- decoding --------------------------------------------------------------------------------------------------


class Image:
    """What the markers of one baseline image say: size, components, tables and where its scan lies."""

    def __init__(self) -> None:
        self.width = self.height = self.restart = 0
        self.quant: dict[int, int] = {}
        self.tables: dict[tuple[int, int], bytes] = {}
        self.parts: list[tuple[int, int, int, int]] = []  # id, horizontal, vertical, quantiser
        self.scan: tuple[int, int] = (0, 0)
        self.pattern: tuple = ()  # of an MCU: (component, DC table, AC table) for each block

    def mcus(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(media: bytes) -> list[Image]:
    """The images in ``media``; ValueError for anything but whole baseline images with one interleaved scan."""
    out, at, im = [], 0, None
    while at < len(media):
        if media[at] != 0xFF or at + 1 >= len(media):
            raise ValueError(f"no marker at byte {at}")
        m = media[at + 1]
        if m == 0xFF:
            at += 1
            continue
        at += 2
        if m == 0xD8:
            im = Image()
            continue
        if m == 0xD9:
            if im is None or not im.pattern:
                raise ValueError("an image without a scan")
            out.append(im)
            im = None
            continue
        if im is None or at + 2 > len(media):
            raise ValueError("a segment outside an image")
        size = struct.unpack_from(">H", media, at)[0]
        body, at = media[at + 2 : at + size], at + size
        if len(body) != size - 2:
            raise ValueError("a cut segment")
        if m == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                im.quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 65 + 64 * wide
        elif m == 0xC0:
            precision, im.height, im.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not im.height or not im.width:
                raise ValueError("not an 8-bit image of known size")
            im.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif m in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline image")
        elif m == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                im.tables[body[k] >> 4, body[k] & 15] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif m == 0xDD:
            im.restart = struct.unpack(">H", body)[0]
        elif m == 0xDA:
            n = body[0]
            if n != len(im.parts) or im.pattern:
                raise ValueError("not one interleaved scan")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(n)}
            blocks = []
            for c, (ident, h, v, _) in enumerate(im.parts):
                h, v = (1, 1) if n == 1 else (h, v)
                blocks += [(c, im.tables[0, chosen[ident] >> 4], im.tables[1, chosen[ident] & 15])] * (h * v)
            if n == 1:
                im.parts = [(im.parts[0][0], 1, 1, im.parts[0][3])]
            im.pattern = tuple(blocks)
            end = _END.search(media, at)
            if not end:
                raise ValueError("a scan without end")
            im.scan = (at, end.start())
            at = end.start()
    if im is not None:
        raise ValueError("an image without end")
    return out


_LUTS: dict[bytes, np.ndarray] = {}


def _lut(table: bytes) -> np.ndarray:
    """length << 8 | symbol for every 16 bits to come; 0 where no code fits."""
    if table not in _LUTS:
        lut = np.zeros(1 << 16, np.int64)
        for s, c, n in codes(table[:16], table[16:]):
            lut[c << (16 - n) : (c + 1) << (16 - n)] = n << 8 | s
        _LUTS[table] = lut
    return _LUTS[table]


def _symbol(window: np.ndarray, at: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next symbol of each lane, the bits after its code, and the code's length."""
    w = window[at >> 3] << (at & 7).astype(_U)
    e = lut[w >> _U(48)]
    n = e >> 8
    return e & 255, w << n.astype(_U), n


def _luminance(data: bytes, images: list[Image], scans: list[tuple[int, int]]) -> list[np.ndarray]:
    """DC coefficients of the first component of images that share one MCU pattern: rows of MCUs x its blocks."""
    pattern = images[0].pattern
    arr = np.frombuffer(data, np.uint8)
    keep = np.zeros(len(arr), bool)
    for s, e in scans:
        keep[s:e] = True
    ff = np.zeros(len(arr), bool)
    ff[:-1] = arr[:-1] == 255
    after = np.zeros(len(arr), np.uint8)
    after[:-1] = arr[1:]
    restart = ff & keep & (after >= 0xD0) & (after <= 0xD7)
    drop = np.zeros(len(arr), bool)
    drop[1:] = (ff & keep & ((after == 0) | restart))[:-1]
    keep &= ~drop & ~restart
    place = np.cumsum(keep) - keep
    body = np.concatenate([arr[keep], np.full(16, 255, np.uint8)])
    window = np.zeros(len(body) - 7, _U)
    for k in range(8):
        window |= body[k : len(body) - 7 + k].astype(_U) << _U(56 - 8 * k)
    marks = np.flatnonzero(restart)
    starts, left, first = [], [], [0]
    for im, (s, e) in zip(images, scans):
        x, y = im.mcus()
        n = x * y
        cuts = marks[np.searchsorted(marks, s) : np.searchsorted(marks, e)]
        step = im.restart or n
        if len(cuts) != -(-n // step) - 1:
            raise ValueError("restart markers do not match the image's size")
        starts.append(place[np.concatenate([[s], cuts + 2]).astype(np.int64)])
        left.append(np.minimum(step, n - step * np.arange(len(cuts) + 1)))
        first.append(first[-1] + len(cuts) + 1)
    at, left = np.concatenate(starts) * 8, np.concatenate(left)
    luma = sum(c == 0 for c, _, _ in pattern)
    coef = np.zeros((len(at), int(left.max()) * luma), np.int32)
    pred = np.zeros((len(images[0].parts), len(at)), np.int64)
    order = np.argsort(-left, kind="stable")  # lanes that end first stand last
    at, ends = at[order], -left[order]
    for mcu in range(int(left.max())):
        n = int(np.searchsorted(ends, -mcu, side="left"))
        bit, b = at[:n], 0
        for c, dc, ac in pattern:
            s, rest, used = _symbol(window, bit, _lut(dc))
            if (used == 0).any() or (s > 11).any():
                raise ValueError("a code that no table has")
            v = np.where(s > 0, rest >> (_U(64) - np.maximum(s, 1).astype(_U)), _U(0)).astype(np.int64)
            pred[c, :n] += np.where(v < (1 << s >> 1), v - (1 << s) + 1, v)
            bit = bit + used + s
            if c == 0:
                coef[:n, mcu * luma + b] = pred[c, :n]
                b += 1
            s, rest, used = _symbol(window, bit, _lut(ac))
            bit = bit + used + (s & 15)
            busy = np.flatnonzero(s != 0)
            k = 1 + (s[busy] >> 4) + np.ones(len(busy), np.int64)
            if (used == 0).any():
                raise ValueError("a code that no table has")
            while len(busy):
                busy = busy[k <= 63]
                k = k[k <= 63]
                if not len(busy):
                    break
                s, rest, used = _symbol(window, bit[busy], _lut(ac))
                if (used == 0).any():
                    raise ValueError("a code that no table has")
                bit[busy] += used + (s & 15)
                go = s != 0
                k = (k + (s >> 4) + 1)[go]
                busy = busy[go]
        at[:n] = bit
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return [np.concatenate([coef[back[i], : left[i] * luma] for i in range(a, z)]).reshape(-1, luma) for a, z in zip(first, first[1:])]


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(width, height, DC-only luminance thumbnail) of each image of each media value; images are decoded together."""
    found = [parse(m) for m in media]
    data = b"".join(media)
    base = np.cumsum([0] + [len(m) for m in media])
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, images in enumerate(found):
        for j, im in enumerate(images):
            groups.setdefault((im.pattern, tuple(p[1:3] for p in im.parts)), []).append((i, j))
    out: list[list] = [[None] * len(images) for images in found]
    for members in groups.values():
        images = [found[i][j] for i, j in members]
        scans = [(int(base[i]) + found[i][j].scan[0], int(base[i]) + found[i][j].scan[1]) for i, j in members]
        for (i, j), im, dc in zip(members, images, _luminance(data, images, scans)):
            x, y = im.mcus()
            _, h, v, q = im.parts[0]
            grid = dc.reshape(y, x, v, h).transpose(0, 2, 1, 3).reshape(y * v, x * h)
            top = [max(p[k] for p in im.parts) for k in (1, 2)]
            grid = grid[: -(-(-(-im.height * v // top[1])) // 8), : -(-(-(-im.width * h // top[0])) // 8)]
            thumb = np.clip((grid.astype(np.int64) * im.quant[q] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            out[i][j] = (im.width, im.height, thumb)
    return out


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid of means lie above the mean of the cells."""
    h, w = thumb.shape
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    if h < 8 or w < 8:  # cells of single, partly repeated pixels
        cells = thumb[np.ix_(rows, cols)].astype(float)
    else:
        cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, 0), cols, 1) / np.outer(np.diff(np.append(rows, h)), np.diff(np.append(cols, w)))
    return int(np.packbits(cells.ravel() > cells.mean()).view(">u8")[0])


def _groups(sizes: list[int], most: int = 1 << 19):
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def store(docs: DataFrame, unit: int = 192) -> DataFrame:
    """(doc_id, n_bytes, media): whole texts, filled with spaces to a positive multiple of ``unit`` bytes, as images."""

    def run(batches):
        for b in batches:
            raw = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            full = [t + b" " * (max(1, -(-len(t) // unit)) * unit - len(t)) for t in raw]
            media: list[bytes] = []
            for s, e in _groups([len(p) for p in full]):
                media += encode(full[s:e])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FEATURES = "width int, height int, n_images int, thumb_hash long, thumb_bytes long, thumb_sha256 string, tail_crc32 long, error string"


def features(stored: DataFrame) -> DataFrame:
    """``stored`` with dimensions of the first image, and hashes of all its images' thumbnails read as one.

    A null or broken ``media`` has null figures and says why in ``error``; it never stops the others. Repeated rows,
    null ids and empty tables pass through; columns with the new names are replaced.
    """
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    stored = stored.drop(*names)

    def figures(images) -> list:
        (w, h, one), pixels = images[0], b"".join(t.tobytes() for _, _, t in images)
        thumb = one if len(images) == 1 or len({t.shape[1] for _, _, t in images}) > 1 else np.concatenate([t for _, _, t in images])
        return [w, h, len(images), int(np.uint64(average_hash(thumb)).view(np.int64)), len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-16:]), None]

    def safe(media: list) -> list[list]:
        try:
            return [figures(x) for x in thumbnails(media)]
        except (ValueError, KeyError, IndexError, TypeError, struct.error) as e:
            if len(media) == 1:
                return [[*[None] * 7, "no media" if media[0] is None else str(e) or "broken"]]
            return [x for m in media for x in safe([m])]

    def run(batches):
        for b in batches:
            media = b.column("media").to_pylist()
            rows: list[list] = []
            for s, e in _groups([len(m or b"") for m in media]):
                rows += safe(media[s:e])
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)]], names=[*b.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields] + [_FEATURES])
    return stored.mapInArrow(run, schema)


def op10_media(spark, sf_dir: str) -> DataFrame:
    found = features(store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    feature = F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit("x"), F.col("n_images"), F.lit(":"), F.lower(F.lpad(F.hex("thumb_hash"), 16, "0")))
    return found.select(
        "doc_id", "n_bytes", F.col("thumb_bytes").alias("payload_bytes"), F.col("thumb_sha256").alias("payload_sha256"), "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
