import hashlib
import os
import struct
import zlib
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from tidemark.llm import media as M


@pytest.mark.parametrize("n", [64, 128, 960, 1024, 1088, 4096, 64 * 1001, 64 * (16 * 1024 * 2 + 5)])
def test_lossless(n):
    for payload in (os.urandom(n), bytes(n), b"\xff" * n, bytes([255, 0] * (n // 2)), bytes(range(64)) * (n // 64)):
        data = M.encode(payload)
        assert M.decode(data)[0] == payload


def test_frames_are_jpeg_by_the_standard():
    """A bit-by-bit decoder that knows only the standard reads the same samples."""
    payload = os.urandom(64 * 20)
    frames, _ = M.read_avi(M.encode(payload))
    out = b""
    for jpeg in frames:
        at, codes, size = 2, {}, None
        while True:
            marker, length = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
            body, at = jpeg[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xC4:
                code, k = 0, 17
                for bits in range(1, 17):
                    for _ in range(body[bits]):
                        codes[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
            elif marker == 0xC3:
                size = struct.unpack_from(">BHHB", body)
            elif marker == 0xDA:
                break
        bits = iter("".join(f"{b:08b}" for b in jpeg[at:-2].replace(b"\xff\x00", b"\xff")))
        _, rows, columns, _ = size
        image = np.zeros((rows, columns), int)
        for y in range(rows):
            for x in range(columns):
                n = code = 0
                while (n, code) not in codes:
                    n, code = n + 1, code << 1 | int(next(bits))
                s = codes[n, code]
                extra = int("".join(next(bits) for _ in range(s)) or "0", 2)
                d = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
                before = image[y, x - 1] if x else image[y - 1, 0] if y else 128
                image[y, x] = before + d
        out += image.astype(np.uint8).tobytes()
    assert out == payload


def lossless_jpeg(image, predictor, lengths, restart=0):
    """A lossless frame by another writer: any predictor, any code lengths."""
    codes, code, last = {}, 0, 0
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    for s in ordered:
        code <<= lengths[s] - last
        codes[s], last, code = (lengths[s], code), lengths[s], code + 1
    parts, bits = [], ""

    def close():
        data = bits + "1" * (-len(bits) % 8)
        return bytes(int(data[i : i + 8], 2) for i in range(0, len(data), 8)).replace(b"\xff", b"\xff\x00")

    fresh = True
    for y, row in enumerate(image.astype(int)):
        if restart and y and y * len(row) % restart == 0:
            parts.append(close())
            bits, fresh = "", True
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), (image[y - 1, x] if y else 0), (image[y - 1, x - 1] if x and y else 0)
            a, b, c = int(a), int(b), int(c)
            guess = 128 if fresh and not x else a if fresh else b if not x else [a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1][predictor - 1]
            d = int(v) - guess
            n = abs(d).bit_length()
            bits += f"{codes[n][1]:0{codes[n][0]}b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "")
        fresh = False
    parts.append(close())
    table = b"\x00" + bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(ordered)
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4" + struct.pack(">H", len(table) + 2) + table + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, *image.shape, 1) + b"\x01\x11\x00"
    if restart:
        head += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    body = b"".join(p + (b"\xff" + bytes([0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))
    return head + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + bytes([predictor, 0, 0]) + body + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
def test_other_lossless_frames(predictor):
    image = np.random.default_rng(predictor).integers(0, 256, (12, 10)).astype(np.uint8)
    lengths = {s: [2, 3, 3, 3, 4, 4, 5, 6, 7, 8][s] for s in range(10)}
    for restart in (0, 40):
        [found] = M.decode_frames([lossless_jpeg(image, predictor, lengths, restart)])
        assert (found == image).all()
    data = M.write_avi([lossless_jpeg(image, predictor, lengths), M.read_avi(M.encode(bytes(1024)))[0][0]])
    assert M.decode(data)[0] == image.tobytes() + bytes(1024)


def baseline_jpeg(image, quantizer=3):
    """A grey baseline frame whose codes all have eight bits."""
    c = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    zigzag, y, x, up = [], 0, 0, True
    while len(zigzag) < 64:
        zigzag.append((y, x))
        if up:
            y, x, up = (y + 1, x, False) if x == 7 else (y, x + 1, False) if y == 0 else (y - 1, x + 1, True)
        else:
            y, x, up = (y, x + 1, True) if y == 7 else (y + 1, x, True) if x == 0 else (y + 1, x - 1, False)
    symbols = sorted({r << 4 | s for r in range(16) for s in range(1, 11)} | {0, 0xF0})
    bits, before = "", 0
    padded = np.pad(image, ((0, -image.shape[0] % 8), (0, -image.shape[1] % 8)), mode="edge").astype(float) - 128

    def number(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    for by in range(0, padded.shape[0], 8):
        for bx in range(0, padded.shape[1], 8):
            f = np.rint(c @ padded[by : by + 8, bx : bx + 8] @ c.T / quantizer).astype(int)
            values = [int(f[p]) for p in zigzag]
            n, text = number(values[0] - before)
            before = values[0]
            bits += f"{n:04b}" + text
            run = 0
            last = max((i for i, v in enumerate(values) if v and i), default=0)
            for v in values[1 : last + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += f"{symbols.index(0xF0):08b}"
                    run -= 16
                n, text = number(v)
                bits += f"{symbols.index(run << 4 | n):08b}" + text
                run = 0
            if last < 63:
                bits += f"{symbols.index(0):08b}"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    dc = b"\x00" + bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12))
    ac = b"\x10" + bytes([*[0] * 7, len(symbols), *[0] * 8]) + bytes(symbols)
    head = b"\xff\xd8\xff\xdb" + struct.pack(">H", 67) + b"\x00" + bytes([quantizer] * 64)
    head += b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, *image.shape, 1) + b"\x01\x11\x00" + b"\xff\xc4" + struct.pack(">H", 2 + len(dc) + len(ac)) + dc + ac
    return head + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x00\x3f\x00" + data + b"\xff\xd9"


def test_baseline_frames():
    y, x = np.mgrid[0:21, 0:35]
    image = (128 + 60 * np.sin(x / 5) + 50 * np.cos(y / 3)).astype(np.uint8)
    [found] = M.decode_frames([baseline_jpeg(image)])
    assert found.shape == image.shape and np.abs(found.astype(int) - image).max() <= 6


def half_up(x, places):
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def brute_feature(text):
    """The feature from the samples, by loops over frames and differences."""
    data = (text or "").encode()
    data += bytes(-len(data) % 64 or (0 if data else 64))
    frames = [data[i : i + 1024] for i in range(0, len(data), 1024)]
    shares = []
    for f in frames:
        bins = [0] * 16
        for b in f:
            bins[b // 16] += 1
        shares.append([n / len(f) for n in bins])
    change = [sum(abs(a - b) for a, b in zip(p, q, strict=True)) / 2 for p, q in zip(shares, shares[1:], strict=False)]
    cuts = []
    for i, v in enumerate(change):
        others = [change[j] for j in range(max(0, i - 12), min(len(change), i + 13)) if j != i]
        mean = sum(others) / max(1, len(others))
        spread = (max(0.0, sum(x * x for x in others) / max(1, len(others)) - mean * mean)) ** 0.5
        if v > max(mean + 2 * spread, 0.05):
            cuts.append(i + 1)
    edges = [0, *cuts, len(frames)]
    shots = []
    for a, b in zip(edges, edges[1:], strict=False):
        samples = b"".join(frames[a:b])
        shots.append(f"{a}-{b}@{half_up(a * 0.04, 2)}/{half_up(change[a - 1] if a else 0.0, 4)}/{half_up(sum(samples) / len(samples), 4)}")
    return f"frames={len(frames)};shots={len(shots)};" + ",".join(shots)


def test_query_against_brute_force(spark, data, documents):
    from tidemark.llm.queries import QUERIES

    found = {r["doc_id"]: r for r in QUERIES["op9_media"](spark, data).collect()}
    for d in documents.collect():
        assert found[d["doc_id"]]["feature"] == brute_feature(d["text"]), d["doc_id"]


def test_without_an_index():
    payload = os.urandom(64 * 40)
    data = M.encode(payload)
    cut = data[: data.rfind(b"idx1")]
    assert M.decode(cut[:4] + struct.pack("<I", len(cut) - 8) + cut[8:])[0] == payload


def test_damage_is_noticed():
    data = M.encode(os.urandom(4096))
    with pytest.raises(M.MediaError):
        M.decode(data[: len(data) // 2])
    with pytest.raises(M.MediaError):
        M.decode(b"RIFF" + struct.pack("<I", 4) + b"WAVE")
    at = data.rfind(b"idx1") + 16
    with pytest.raises(M.MediaError):
        M.decode(data[:at] + b"\x09" + data[at + 1 :])
    with pytest.raises(M.MediaError):
        M.encode(b"x")


def test_shots():
    dark, light = [np.full((16, 64), v, np.uint8) for v in (20, 200)]
    found = M.clips([dark] * 5 + [light] * 7 + [dark] * 3, 0.04)
    assert [(a, b) for a, b, *_ in found] == [(0, 5), (5, 12), (12, 15)]
    assert [round(t, 2) for _, _, t, *_ in found] == [0.0, 0.2, 0.48]
    assert [x[5] for x in found] == [20.0, 200.0, 20.0]
    assert M.clips([dark], 0.04) == [(0, 1, 0.0, 0.04, 0.0, 20.0)]


def test_rows(odd, nothing):
    found = M.feature(M.read_media(M.media_column(odd)))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == odd.count()
    for d in odd.collect():
        text = (d["text"] or "").encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = M.encode(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[1]["feature"] == rows[2]["feature"] and rows[3]["media_sha256"] == rows[4]["media_sha256"]
    assert M.read_media(M.media_column(nothing)).count() == 0
    clips = M.clip_rows(M.read_media(M.media_column(odd.where("doc_id = 5"))).limit(1)).orderBy("clip").collect()
    assert clips[0]["first"] == 0 and clips[-1]["end"] == -(-len(M.payload_of(odd.where("doc_id = 5").first()["text"])[1]) // 1024)
