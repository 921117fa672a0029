"""AVI motion-JPEG columns: lossless frames, RIFF indexes and shot detection.

``encode`` stores bytes as 8-bit grey samples, ``SIDE`` in a row and at most ``ROWS``
rows in a frame.  Each frame is a lossless intra JPEG (SOF3, first-order prediction).
Its Huffman table gives a difference of s bits a code of 9 - s bits, so each sample
takes nine bits and whole texts can be coded and decoded as arrays.  The frames go
into an AVI file: header lists, a ``movi`` list of ``00dc`` chunks, and an ``idx1``
index.

``decode`` parses the RIFF tree, follows the index (or scans ``movi`` where there is
none), decodes every video frame from its own JPEG tables and returns the samples.
Besides the files that ``encode`` writes, whose frames are decoded as arrays, it reads
other lossless grey frames (any Huffman table and predictor) and baseline frames (one
component, or the luminance of several), one code after another.
``clips`` compares grey histograms of neighbouring frames; a cut is a difference over
an adaptive threshold, mean plus ``CUT_SIGMAS`` deviations of a sliding window of
differences, and the frames between two cuts are a clip with a start and an end time.

Defined cases: a null or empty text is one row of zero samples; a null id stays null; a
one-frame file is one clip; equal texts, and rows that repeat, give equal bytes and
clips; ties in grey fall into the same bin; texts of any length are coded whole, with
memory in proportion to one text and ``SLICE_BYTES`` of short ones; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_schema, bounded, struct_of, texts_of

SIDE, ROWS = 64, 16
RATE = 25
BINS = 16
CUT_WINDOW, CUT_SIGMAS, CUT_LEAST = 12, 2.0, 0.05
UNIT = 64
#: Frames that are coded or decoded as one array.
SLAB = 1_024

#: Bits of a difference -> length of its code: nine bits for every sample.
CODE_BITS = {s: 9 - s for s in range(9)}


class MediaError(ValueError):
    """The bytes aren't a file that this module can read."""


def _canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Huffman codes in JPEG's canonical order."""
    codes, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        codes[symbol] = code
        code, last = code + 1, n
    return codes


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit word of each difference (index: difference + 255), and the reverse."""
    codes, words, back = _canonical(CODE_BITS), np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << s) - 1
        words[d + 255] = codes[s] << s | (extra if s else 0)
        back[words[d + 255]] = d
    return words, back


_WORDS, _BACK = _tables()


def _pack9(words: np.ndarray) -> np.ndarray:
    """Nine-bit words, a multiple of eight of them, as bytes."""
    bits = np.empty((len(words), 9), np.uint8)
    for i in range(9):
        bits[:, i] = (words >> (8 - i)) & 1
    return np.packbits(bits.reshape(-1))


def _unpack9(data: np.ndarray) -> np.ndarray:
    """The reverse of ``_pack9``: word i of eight lies in bytes i and i + 1 of nine."""
    nine = data.reshape(-1, 9).astype(np.uint16)
    words = np.empty((len(nine), 8), np.uint16)
    for i in range(8):
        words[:, i] = ((nine[:, i] << 8 | nine[:, i + 1]) >> (7 - i)) & 0x1FF
    return words.reshape(-1)


def _jpeg_head(rows: int) -> bytes:
    by_length = sorted(CODE_BITS, key=lambda s: (CODE_BITS[s], s))
    counts = bytes(sum(n == length for n in CODE_BITS.values()) for length in range(1, 17))
    table = b"\x00" + counts + bytes(by_length)
    return b"\xff\xd8" + b"\xff\xc4" + struct.pack(">H", len(table) + 2) + table + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, rows, SIDE, 1) + b"\x01\x11\x00" + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x01\x00\x00"


def _frame_groups(samples: np.ndarray) -> list[np.ndarray]:
    """(frames, rows, SIDE) arrays: the full frames, at most SLAB at a time, then the last one."""
    full = len(samples) // ROWS * ROWS
    groups = [samples[i : min(i + SLAB * ROWS, full)].reshape(-1, ROWS, SIDE) for i in range(0, full, SLAB * ROWS)]
    return groups + ([samples[full:].reshape(1, -1, SIDE)] if full < len(samples) else [])


def encode(payload: bytes) -> bytes:
    """An AVI file of lossless frames; the payload is a positive multiple of 64 bytes."""
    if not payload or len(payload) % UNIT:
        raise MediaError("a payload is a positive multiple of 64 bytes")
    frames: list[bytes] = []
    for group in _frame_groups(np.frombuffer(payload, np.uint8).reshape(-1, SIDE)):
        g = group.astype(np.int16)
        d = np.empty_like(g)
        d[:, :, 1:] = g[:, :, 1:] - g[:, :, :-1]
        d[:, 1:, 0] = g[:, 1:, 0] - g[:, :-1, 0]
        d[:, 0, 0] = g[:, 0, 0] - 128
        data = _pack9(_WORDS[d.reshape(-1) + 255]).reshape(len(g), -1)
        head = _jpeg_head(g.shape[1])
        frames += [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in data]
    return write_avi(frames)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) % 2)


def write_avi(frames: list[bytes], side: int = SIDE, rows: int = ROWS, rate: int = RATE) -> bytes:
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, side, rows, 0, 0, 0, 0)
    stream = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, side, rows)
    bitmap = struct.pack("<IiiHH", 40, side, rows, 1, 8) + b"MJPG" + struct.pack("<IiiII", side * rows, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    starts = list(accumulate((len(c) for c in chunks), initial=4))
    index = b"".join(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)) for at, f in zip(starts, frames, strict=False))
    body = b"AVI " + header + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def riff(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of each chunk in a span; a list's name is its type."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        stop = start + 8 + size
        if stop > end:
            raise MediaError(f"the chunk {name!r} declares {size} bytes, {end - start - 8} are left")
        if name in (b"RIFF", b"LIST"):
            yield data[start + 8 : start + 12], start + 12, stop
        else:
            yield name, start + 8, stop
        start = stop + size % 2


VIDEO = (b"dc", b"db")


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The video frames by the index, and seconds a frame."""
    top = next(riff(data, 0, len(data)), None)
    if top is None or top[0] != b"AVI ":
        raise MediaError("no AVI file")
    parts = {name: (a, b) for name, a, b in riff(data, top[1], top[2])}
    if b"hdrl" not in parts or b"movi" not in parts:
        raise MediaError("an AVI file without headers or frames")
    seconds = next((struct.unpack_from("<I", data, a)[0] / 1e6 for name, a, _ in riff(data, *parts[b"hdrl"]) if name == b"avih"), 1 / RATE)
    movi, stop = parts[b"movi"]
    if b"idx1" not in parts:
        return [data[a:b] for name, a, b in riff(data, movi, stop) if name[2:] in VIDEO], seconds
    entries = np.frombuffer(data[slice(*parts[b"idx1"])], np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    # places count from the list's type, or with some writers from the file's start
    base, frames = movi - 4, []
    start = int(entries["at"][0]) if len(entries) else 0
    if len(entries) and data[base + start : base + start + 4] != entries["id"][0] and data[start : start + 4] == entries["id"][0]:
        base = 0
    for name, at, size in zip(entries["id"].tolist(), entries["at"].tolist(), entries["size"].tolist(), strict=True):
        if name[2:] not in VIDEO:
            continue
        if data[base + at : base + at + 4] != name or struct.unpack_from("<I", data, base + at + 4)[0] != size:
            raise MediaError("the index doesn't fit the chunks")
        frames.append(data[base + at + 8 : base + at + 8 + size])
    return frames, seconds


class Jpeg:
    """A frame's header and entropy-coded bytes."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise MediaError("no JPEG frame")
        self.huffman: dict[int, dict[int, int]] = {}  # class and number -> length of each symbol's code
        self.order: dict[int, list[int]] = {}
        self.quantizers: dict[int, np.ndarray] = {}
        self.kind = self.restart = 0
        at = 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise MediaError("a JPEG frame ends in its header")
            marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDB:
                self._quantizers(body)
            elif marker in (0xC0, 0xC1, 0xC3):
                self.kind = marker
                self.bits, self.rows, self.columns, n = struct.unpack_from(">BHHB", body)
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise MediaError(f"a JPEG frame of kind {marker:#x}")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if not self.kind or self.bits != 8:
                    raise MediaError("no 8-bit JPEG frame")
                n = body[0]
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)}
                self.predictor, _, low = body[1 + 2 * n : 4 + 2 * n]
                if len(self.scan) != len(self.components) or self.kind == 0xC3 and (n != 1 or low & 15):
                    raise MediaError("a JPEG frame of several scans or shifted samples")
                end = data.rfind(b"\xff\xd9")
                self.data = data[at : end if end >= at else len(data)]
                return

    def _huffman(self, body: bytes) -> None:
        while body:
            counts, n = body[1:17], sum(body[1:17])
            lengths = [k for k, c in enumerate(counts, 1) for _ in range(c)]
            self.huffman[body[0]], self.order[body[0]] = dict(zip(body[17 : 17 + n], lengths, strict=True)), list(body[17 : 17 + n])
            body = body[17 + n :]

    def _quantizers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            self.quantizers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
            body = body[1 + 64 * (1 + wide) :]

    @property
    def plain(self) -> bool:
        """Whether it is of the form that ``encode`` writes."""
        return self.kind == 0xC3 and self.predictor == 1 and not self.restart and self.huffman.get(0) == CODE_BITS

    def lookup(self, number: int) -> list[tuple[int, int]]:
        """(length, symbol) of the code that each 16 bits begin with."""
        if number not in self.huffman:
            raise MediaError("a JPEG frame without its Huffman table")
        out, code, last = [(0, 0)] * 65_536, 0, 0
        for symbol in self.order[number]:
            n = self.huffman[number][symbol]
            code <<= n - last
            out[code << (16 - n) : (code + 1) << (16 - n)] = [(n, symbol)] * (1 << (16 - n))
            code, last = code + 1, n
        return out

    def stretches(self) -> list[bytes]:
        """The entropy-coded bytes between restart markers, without stuffing."""
        return [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", self.data)]


class _Bits:
    """Codes and numbers from a stretch of bytes; ``windows[i]``: the 16 bits from bit i on."""

    def __init__(self, data: bytes):
        wide = np.frombuffer(data + b"\x00" * 6, np.uint8).astype(np.uint32)
        three = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
        self.windows = ((three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)) & 0xFFFF).reshape(-1).tolist()
        self.at = 0

    def code(self, table: list[tuple[int, int]]) -> int:
        if self.at + 16 > len(self.windows):
            raise MediaError("a JPEG frame ends in its samples")
        n, symbol = table[self.windows[self.at]]
        if not n:
            raise MediaError("a code that no Huffman table has")
        self.at += n
        return symbol

    def number(self, size: int) -> int:
        """A signed difference of ``size`` bits."""
        if not size:
            return 0
        if self.at + 16 > len(self.windows):
            raise MediaError("a JPEG frame ends in its samples")
        x = self.windows[self.at] >> (16 - size)
        self.at += size
        return x if x >> (size - 1) else x - (1 << size) + 1


def _lossless(jpeg: Jpeg) -> np.ndarray:
    """A lossless grey frame, sample by sample."""
    rows, columns, way = jpeg.rows, jpeg.columns, jpeg.predictor
    if not 1 <= way <= 7 or len(jpeg.components) != 1:
        raise MediaError("no lossless grey frame")
    table = jpeg.lookup(next(iter(jpeg.scan.values()))[0])
    parts = iter(jpeg.stretches())
    bits, out, fresh = _Bits(next(parts)), [], True
    above: list[int] = []
    for y in range(rows):
        if jpeg.restart and y and y * columns % jpeg.restart == 0:
            bits, fresh = _Bits(next(parts)), True
        row: list[int] = []
        for x in range(columns):
            if fresh and not x:
                guess = 128
            elif fresh:
                guess = row[-1]
            elif not x:
                guess = above[0]
            else:
                a, b, c = row[-1], above[x], above[x - 1]
                guess = (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[way - 1]
            row.append((guess + bits.number(bits.code(table))) & 0xFFFF)
        out.append(row)
        above, fresh = row, False
    return (np.array(out).reshape(rows, columns) & 0xFF).astype(np.uint8)


# The zigzag order of a block, by its rule, and the cosines of its transform.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COSINES = np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _baseline(jpeg: Jpeg) -> np.ndarray:
    """The grey samples of a baseline frame: its one component, or the first of several."""
    tables = {i: (jpeg.lookup(dc), jpeg.lookup(0x10 | ac)) for i, (dc, ac) in jpeg.scan.items()}
    alone = len(jpeg.components) == 1
    components = [(i, 1, 1, q) if alone else (i, h, v, q) for i, h, v, q in jpeg.components]
    most_h, most_v = max(h for _, h, *_ in components), max(v for *_, v, _ in components)
    wide, high = -(-jpeg.columns // (8 * most_h)), -(-jpeg.rows // (8 * most_v))
    first, h1, v1, quantizer = components[0]
    if quantizer not in jpeg.quantizers:
        raise MediaError("a JPEG frame without its quantizers")
    blocks = np.zeros((high * v1, wide * h1, 64), np.int32)
    parts = iter(jpeg.stretches())
    bits, before = _Bits(next(parts)), dict.fromkeys(tables, 0)
    for unit in range(wide * high):
        if jpeg.restart and unit and unit % jpeg.restart == 0:
            bits, before = _Bits(next(parts)), dict.fromkeys(tables, 0)
        for i, h, v, _ in components:
            dc, ac = tables[i]
            for k in range(h * v):
                before[i] += bits.number(bits.code(dc))
                block = {0: before[i]}
                at = 1
                while at < 64:
                    symbol = bits.code(ac)
                    run, size = symbol >> 4, symbol & 15
                    if not size and run != 15:
                        break
                    at += run
                    if size and at < 64:
                        block[at] = bits.number(size)
                    at += 1
                if i == first:
                    spot = blocks[unit // wide * v + k // h, unit % wide * h + k % h]
                    spot[list(block)] = list(block.values())
    flat = np.zeros_like(blocks)
    flat[:, :, ZIGZAG] = blocks * jpeg.quantizers[quantizer]
    samples = np.einsum("ux,abuv,vy->axby", _COSINES, flat.reshape(*flat.shape[:2], 8, 8).astype(float), _COSINES)
    whole = np.clip(np.rint(samples) + 128, 0, 255).astype(np.uint8).reshape(8 * blocks.shape[0], -1)
    return whole[: -(-jpeg.rows * v1 // most_v), : -(-jpeg.columns * h1 // most_h)]


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray]:
    """Samples of each frame; plain frames of one size are decoded together."""
    parsed = list(map(Jpeg, jpegs))
    out: list[np.ndarray] = []
    i = 0
    while i < len(parsed):
        x = parsed[i]
        if not x.plain:
            out.append(_lossless(x) if x.kind == 0xC3 else _baseline(x))
            i += 1
            continue
        j = i
        while j < len(parsed) and j < i + SLAB and parsed[j].plain and (parsed[j].rows, parsed[j].columns) == (x.rows, x.columns):
            j += 1
        data = np.frombuffer(b"".join(p.data.replace(b"\xff\x00", b"\xff") for p in parsed[i:j]), np.uint8)
        if len(data) * 8 < (j - i) * x.rows * x.columns * 9 or len(data) % 9 or x.rows * x.columns % 8:
            raise MediaError("a JPEG frame ends in its samples")
        d = _BACK[_unpack9(data)].astype(np.int32).reshape(j - i, x.rows, x.columns)
        d[:, :, 0] = np.cumsum(d[:, :, 0], 1) + 128
        out += list(np.cumsum(d, 2).astype(np.uint8))
        i = j
    return out


def decode(data: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """(payload, frames, seconds a frame) of a stored file."""
    jpegs, seconds = read_avi(data)
    frames = decode_frames(jpegs)
    return b"".join(f.tobytes() for f in frames), frames, seconds


def clips(frames: list[np.ndarray], seconds: float) -> list[tuple[int, int, float, float, float, float]]:
    """(first frame, end frame, start s, end s, difference at the start, mean grey) of each shot."""
    sizes = np.array([f.size for f in frames])
    grey = np.array([int(f.sum()) for f in frames])
    if len(frames) == 1:
        return [(0, 1, 0.0, seconds, 0.0, int(grey[0]) / int(sizes[0]))]
    shares = np.stack([np.bincount(f.reshape(-1) >> 4, minlength=BINS) / f.size for f in frames])
    change = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    # sliding mean and deviation of the differences before and around each one, itself left out
    n = len(change)
    sums, squares = np.r_[0, np.cumsum(change)], np.r_[0, np.cumsum(change**2)]
    low, high = np.maximum(0, np.arange(n) - CUT_WINDOW), np.minimum(n, np.arange(n) + CUT_WINDOW + 1)
    others = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - change) / others
    deviation = np.sqrt(np.maximum(0, (squares[high] - squares[low] - change**2) / others - mean**2))
    cuts = np.flatnonzero(change > np.maximum(mean + CUT_SIGMAS * deviation, CUT_LEAST)) + 1
    edges = [0, *cuts.tolist(), len(frames)]
    return [(a, b, a * seconds, b * seconds, float(change[a - 1]) if a else 0.0, int(grey[a:b].sum()) / int(sizes[a:b].sum())) for a, b in zip(edges, edges[1:], strict=False)]


def payload_of(text: str) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + b"\x00" * (-len(data) % UNIT or (UNIT if not data else 0))


def media_column(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            stored = [(n, encode(p)) for n, p in map(payload_of, texts_of(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in stored], pa.int64()), pa.array([m for _, m in stored], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


CLIP = struct_of("first int, end int, start_s double, end_s double, change double, grey double")
READ = struct_of("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int").add("clips", T.ArrayType(CLIP))


def read_media(media: DataFrame) -> DataFrame:
    """What each stored file holds: digests of its samples, and its clips."""
    schema = arrow_schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "media"):
            out: list[tuple] = []
            for doc, n, stored in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                data = stored.as_py()
                payload, frames, seconds = decode(data)
                shots = [dict(zip(CLIP.names, c, strict=True)) for c in clips(frames, seconds)]
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), len(frames), shots))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return media.mapInArrow(run, READ)


def clip_rows(read: DataFrame) -> DataFrame:
    """A timed row for each clip."""
    return read.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def feature(read: DataFrame) -> DataFrame:
    """``feature``: frames, and each clip as first-end at its time, with its cut's strength and its mean grey."""
    shots = F.transform("clips", lambda c: F.format_string("%d-%d@%.2f/%.4f/%.4f", c["first"], c["end"], c["start_s"], c["change"], c["grey"]))
    return read.withColumn("feature", F.concat(F.lit("frames="), F.col("n_frames").cast("string"), F.lit(";shots="), F.size("clips").cast("string"), F.lit(";"), F.array_join(shots, ","))).drop("clips")
