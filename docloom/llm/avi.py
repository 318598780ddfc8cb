"""Motion-JPEG in AVI: writing, RIFF index parsing, intra-frame decoding, shot detection.

Frames are lossless JPEG (process 14, SOF3, one 8-bit component), so bytes stored as samples come back unchanged. The writer's
Huffman table gives category s a code of 9 - s bits, which makes every difference exactly 9 bits long with its s extra bits:
frames pack and unpack as whole arrays. The decoder reads any table and the predictors 1 to 7; other tables take a loop. Frames of
other writers, baseline or extended sequential JPEG with any sampling, are decoded to their luminance.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from docloom.llm.common import map_rows, pick

WIDTH, ROWS, FRAME_MS = 64, 64, 40
#: Code lengths 1 to 9 have one code each; shortest first they stand for categories 8 down to 0.
COUNTS, CATEGORIES = [1] * 9 + [0] * 7, list(range(8, -1, -1))
BINS = 16


def code_table() -> np.ndarray:
    """9-bit word of each difference -255 to 255, at index difference + 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        out[d + 255] = ((1 << 8 - s) - 1) << s + 1 | (d if d >= 0 else d + (1 << s) - 1)
    return out


CODES = code_table()
VALUES = np.zeros(512, np.int16)
VALUES[CODES] = np.arange(-255, 256)
WEIGHTS = 1 << np.arange(8, -1, -1).astype(np.uint16)


def marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def encode_frame(a: np.ndarray) -> bytes:
    """Lossless JPEG of a uint8 array, each sample predicted by its left neighbour, the first of a row by the one above."""
    d = a.astype(np.int16)
    d[:, 1:] -= a[:, :-1]
    d[1:, 0] -= a[:-1, 0]
    d[0, 0] -= 128
    words = CODES[d.ravel() + 255]
    bits = ((words[:, None] >> np.arange(8, -1, -1).astype(np.uint16)) & 1).astype(np.uint8).ravel()
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    scan = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
    head = marker(0xC4, bytes([0, *COUNTS, *CATEGORIES])) + marker(0xC3, struct.pack(">BHHBBBB", 8, *a.shape, 1, 1, 0x11, 0))
    return b"\xff\xd8" + head + marker(0xDA, bytes([1, 1, 0, 1, 0, 0])) + scan + b"\xff\xd9"


def predicted(d: np.ndarray, predictor: int) -> np.ndarray:
    """Samples from differences."""
    rows, cols = d.shape
    if predictor == 1:
        d = d.astype(np.int64)
        d[0, 0] += 128
        d[:, 0] = np.cumsum(d[:, 0])
        return (np.cumsum(d, axis=1) & 0xFF).astype(np.uint8)
    x = np.zeros((rows, cols), np.int64)
    for r in range(rows):
        for c in range(cols):
            if r == 0:
                p = x[0, c - 1] if c else 128
            elif c == 0:
                p = x[r - 1, 0]
            else:
                ra, rb, rc = int(x[r, c - 1]), int(x[r - 1, c]), int(x[r - 1, c - 1])
                p = (0, ra, rb, rc, ra + rb - rc, ra + (rb - rc >> 1), rb + (ra - rc >> 1), ra + rb >> 1)[predictor]
            x[r, c] = (p + int(d[r, c])) & 0xFFFF
    return x.astype(np.uint8)


def any_differences(data: bytes, counts: list[int], categories: list[int], n: int) -> np.ndarray:
    """Huffman decoding with any table, bit by bit."""
    codes, code, k = {}, 0, 0
    for length, m in enumerate(counts, 1):
        for _ in range(m):
            codes[length, code] = categories[k]
            code, k = code + 1, k + 1
        code <<= 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    out, at = np.zeros(n, np.int64), 0
    for i in range(n):
        code = length = 0
        while (length, code) not in codes:
            code, length, at = code << 1 | bits[at], length + 1, at + 1
        s = codes[length, code]
        v = 0
        for b in bits[at : at + s] if s < 16 else []:
            v = v << 1 | b
        at += s if s < 16 else 0
        out[i] = 32768 if s == 16 else v if not s or v >> s - 1 else v - (1 << s) + 1
    return out


#: Places of the 64 coefficients of a block in the order of the scan: by diagonals, turning at each end.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
#: The Huffman tables that frames without any imply: code counts by length, and the symbols up to where all others follow in order. Fixed values.
DC_COUNTS = ([0, 1, 5, 1, 1, 1, 1, 1, 1], [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1])
AC_COUNTS = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119])
AC_FIRST = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)


#: What ends a scan: a marker that is neither a stuffed byte nor a restart.
MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


@lru_cache(1)
def implied_tables() -> dict[int, tuple[bytes, bytes]]:
    """Class and number of a table to its counts and symbols."""
    out = {}
    for n in (0, 1):
        first = bytes.fromhex(AC_FIRST[n])
        rest = sorted({16 * run + size for run in range(16) for size in range(1, 11)} - set(first))
        out[n] = bytes(DC_COUNTS[n]).ljust(16, b"\0"), bytes(range(12))
        out[16 + n] = bytes(AC_COUNTS[n]), first + bytes(rest)
    return out


@lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """length << 8 | symbol for each next 16 bits; 0 where no code matches."""
    out, code, k = [0] * 65536, 0, 0
    for length, m in enumerate(counts, 1):
        for x in symbols[k : k + m]:
            at, n = code << 16 - length, 1 << 16 - length
            out[at : at + n] = [length << 8 | x] * n
            code += 1
        k, code = k + m, code << 1
    return out


@lru_cache(1)
def cosines() -> np.ndarray:
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x * np.pi / 16) / 2
    c[:, 0] = np.sqrt(1 / 8)
    return c


class Part(NamedTuple):
    """A component of a frame: horizontal and vertical sampling, quantisation table, coefficients by block row and column."""

    across: int
    down: int
    table: int
    blocks: np.ndarray


def read_scan(scan: bytes, units: list[list[tuple[Part, int, int, list[int], list[int]]]], every: int) -> None:
    """Entropy decoding of one scan: units lists the blocks (part, row, column, DC and AC look-up) of each unit; predictions restart after `every` units."""
    pieces, begin = [], 0
    for i in range(len(scan) - 1):  # restart markers
        if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
            pieces.append(scan[begin:i])
            begin = i + 2
    pieces = [x.replace(b"\xff\x00", b"\xff") + bytes(8) for x in [*pieces, scan[begin:]]]
    data, at, last, piece = pieces[0], 0, {}, 0

    def bits(n: int) -> int:
        nonlocal at
        i = at >> 3
        v = int.from_bytes(data[i : i + 4], "big") >> 32 - n - (at & 7) & (1 << n) - 1
        at += n
        return v

    def symbol(table: list[int]) -> int:
        nonlocal at
        i = at >> 3
        if i + 3 > len(data):
            raise ValueError("scan ends early")
        x = table[(data[i] << 16 | data[i + 1] << 8 | data[i + 2]) >> 8 - (at & 7) & 0xFFFF]
        if not x:
            raise ValueError("no such code")
        at += x >> 8
        return x & 255

    def extended(size: int) -> int:
        v = bits(size)
        return v if v >> size - 1 else v - (1 << size) + 1

    for n, unit in enumerate(units):
        if every and n and n % every == 0:
            piece += 1
            if piece == len(pieces):
                raise ValueError("restart marker missing")
            data, at, last = pieces[piece], 0, {}
        for part, row, column, dc, ac in unit:
            block = part.blocks[row, column]
            size = symbol(dc)
            last[id(part)] = block[0] = last.get(id(part), 0) + (extended(size) if size else 0)
            k = 1
            while k < 64:
                x = symbol(ac)
                size = x & 15
                if not size and x != 0xF0:
                    break
                k += x >> 4
                if size:
                    if k > 63:
                        raise ValueError("too many coefficients")
                    block[ZIGZAG[k]] = extended(size)
                k += 1


def luminance(part: Part, table: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Samples of a component at its own size."""
    high, wide = part.blocks.shape[:2]
    c = cosines()
    x = c @ (part.blocks.astype(np.float64) * table).reshape(-1, 8, 8) @ c.T
    x = np.clip(np.rint(x) + 128, 0, 255).astype(np.uint8)
    return x.reshape(high, wide, 8, 8).swapaxes(1, 2).reshape(8 * high, 8 * wide)[:rows, :cols]


def decode_frame(data: bytes) -> np.ndarray:
    """Samples of a lossless frame of one component, or the luminance of a sequential one."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, shape, lossless = 2, None, False
    parts: dict[int, Part] = {}
    quant: dict[int, np.ndarray] = {}
    tables = dict(implied_tables())
    every, done = 0, set()
    while True:
        while data[at : at + 2] == b"\xff\xff":  # fill bytes
            at += 1
        if data[at + 1 : at + 2] == b"\xd9" and done:
            break
        code, length = struct.unpack_from(">xBH", data, at)
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if code == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif code == 0xDB:
            while body:
                wide = body[0] >> 4
                own = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                quant[body[0] & 15] = np.zeros(64)
                quant[body[0] & 15][ZIGZAG] = own
                body = body[65 + 64 * wide :]
        elif code == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif code in (0xC0, 0xC1, 0xC3):
            bits, rows, cols, count = struct.unpack(">BHHB", body[:6])
            lossless = code == 0xC3
            if bits != 8 or (lossless and count != 1) or not rows or not cols:
                raise ValueError("only samples of 8 bits, of one component in lossless frames")
            shape = rows, cols
            told = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            most_x, most_y = max(x for _, x, _, _ in told), max(y for _, _, y, _ in told)
            across, down = -(-cols // (8 * most_x)), -(-rows // (8 * most_y))
            parts = {i: Part(x, y, q, np.zeros((0 if lossless else down * y, across * x, 64), np.int32)) for i, x, y, q in told}
        elif code == 0xDA:
            if not shape:
                raise ValueError("scan before frame")
            end = found.start() if (found := MARKER.search(data, at)) else len(data)
            if lossless:
                return lossless_samples(data[at:end], tables.get(body[2] >> 4), shape, body[3])
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            coded = [(parts[i], lookup(*tables[t >> 4]), lookup(*tables[16 + (t & 15)])) for i, t in chosen]
            if len(coded) == 1:
                part, dc, ac = coded[0]
                wide, high = -(-cols * part.across // (8 * most_x)), -(-rows * part.down // (8 * most_y))
                units = [[(part, r, c, dc, ac)] for r in range(high) for c in range(wide)]
            else:
                units = [[(p, r * p.down + y, c * p.across + x, dc, ac) for p, dc, ac in coded for y in range(p.down) for x in range(p.across)] for r in range(down) for c in range(across)]
            read_scan(data[at:end], units, every)
            done |= {i for i, _ in chosen}
            at = end
        elif 0xC0 <= code <= 0xCF and code not in (0xC8, 0xCC):
            raise ValueError(f"JPEG process {code:x} is not read")
    first = next(iter(parts.values()))
    if first.table not in quant:
        raise ValueError("no quantisation table")
    return luminance(first, quant[first.table], -(-rows * first.down // most_y), -(-cols * first.across // most_x))


def lossless_samples(scan: bytes, table: tuple[bytes, bytes], shape: tuple[int, int], predictor: int) -> np.ndarray:
    counts, categories = list(table[0]), list(table[1])
    n = shape[0] * shape[1]
    scan = scan.replace(b"\xff\x00", b"\xff")
    if (counts, categories) == (COUNTS, CATEGORIES):
        bits = np.unpackbits(np.frombuffer(scan, np.uint8), count=9 * n).reshape(n, 9)
        d = VALUES[bits @ WEIGHTS]
    else:
        d = any_differences(scan, counts, categories, n)
    return predicted(d.reshape(shape), predictor)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """AVI of a payload whose length is a multiple of 64; the last frame is filled up with zeros and the length is kept in INFO."""
    rows = len(payload) // WIDTH
    high = min(ROWS, rows)
    count = -(-rows // high)
    frames, index, at = [], [], 4
    for i in range(count):
        part = payload[i * high * WIDTH : (i + 1) * high * WIDTH]
        body = encode_frame(np.frombuffer(part.ljust(high * WIDTH, b"\0"), np.uint8).reshape(high, WIDTH))
        frames.append(chunk(b"00dc", body))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(body)))
        at += len(frames[-1])
    most = max(map(len, frames))
    avih = struct.pack("<14I", FRAME_MS * 1000, 0, 0, 0x10, count, 0, 1, most, WIDTH, high, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MS, 1000, 0, count, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, high, 1, 8, b"MJPG", WIDTH * high, 0, 0, 256, 0)
    head = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    info = b"INFO" + chunk(b"ICMT", f"payload={len(payload)}".encode())
    body = b"AVI " + chunk(b"LIST", head) + chunk(b"LIST", info) + chunk(b"LIST", b"movi" + b"".join(frames)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Avi(NamedTuple):
    frames: list[tuple[int, int]]  # offset and length of each frame's data
    frame_us: int
    payload: int | None


def parse_avi(data: bytes) -> Avi:
    """Frames by the RIFF index idx1, or by walking movi where there is none. Index offsets may count from movi or from the file's start."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            if name == b"LIST":
                found[data[at + 8 : at + 12]] = at + 12, size - 4
                if data[at + 8 : at + 12] != b"movi":
                    walk(at + 12, at + 8 + size)
            else:
                found.setdefault(name, (at + 8, size))
            at += 8 + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    start, length = found[b"movi"]
    frames = []
    if b"idx1" in found:
        at, size = found[b"idx1"]
        entries = [struct.unpack_from("<4sIII", data, k) for k in range(at, at + size - 15, 16)]
        entries = [e for e in entries if e[0][2:] in (b"dc", b"db")]
        first = entries[0][2] if entries else 0
        base = start - 4 if data[start - 4 + first : start + first] == (entries[0][0] if entries else b"") else 0
        frames = [(base + e[2] + 8, e[3]) for e in entries]
    else:
        at = start
        while at + 8 <= start + length:
            name, size = struct.unpack_from("<4sI", data, at)
            if name[2:] in (b"dc", b"db"):
                frames.append((at + 8, size))
            at += 8 + size + size % 2
    note = data[found[b"ICMT"][0] :][: found[b"ICMT"][1]] if b"ICMT" in found else b""
    return Avi(frames, struct.unpack_from("<I", data, found[b"avih"][0])[0], int(note[8:]) if note.startswith(b"payload=") else None)


def shots(histograms: np.ndarray, window: int = 8, times: float = 3.0, floor: float = 0.15) -> list[tuple[int, int]]:
    """(first, last frame) of each shot. A cut is where the histogram difference exceeds the mean of the last `window`
    differences of the shot by `times` their deviation, and `floor` at least."""
    out, first, recent = [], 0, []
    for i in range(1, len(histograms)):
        d = float(np.abs(histograms[i] - histograms[i - 1]).sum()) / 2
        limit = max(floor, np.mean(recent) + times * np.std(recent)) if len(recent) >= 2 else max(floor, 0.5)
        if d > limit:
            out.append((first, i - 1))
            first, recent = i, []
        else:
            recent = [*recent[1 - window :], d]
    return [*out, (first, len(histograms) - 1)] if len(histograms) else []


def decode(media: bytes) -> tuple[bytes, np.ndarray, list[tuple[int, int]], int]:
    """Payload, histogram of each frame, shots, microseconds a frame."""
    avi = parse_avi(media)
    parts, histograms = [], []
    for at, size in avi.frames:
        a = decode_frame(media[at : at + size])
        parts.append(a.tobytes())
        histograms.append(np.bincount(a.ravel() >> 4, minlength=BINS) / a.size)
    h = np.array(histograms).reshape(-1, BINS)
    payload = b"".join(parts)
    return payload if avi.payload is None else payload[: avi.payload], h, shots(h), avi.frame_us


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each document's text as an AVI file. Null text counts as empty, one row of zeros."""
    return map_rows(pick(docs, "doc_id", "text"), lambda: lambda doc, text: [doc, [write_avi(padded(t)[1]) for t in text]], "doc_id bigint, media binary")


#: Columns of clips().
CLIP = "doc_id bigint, clip int, first_frame int, last_frame int, start_ms bigint, end_ms bigint, status string"


def clips(media: DataFrame) -> DataFrame:
    """CLIP rows of rows (doc_id, media): the shots of each with their times and status ok; media that is null or cannot be decoded gives one row
    without a clip, whose status tells why, and media without a frame one of status empty.
    """

    def start() -> Callable:
        def work(doc: list, data: list) -> list:
            out: list[list] = [[] for _ in range(7)]
            for d, x in zip(doc, data):
                us, found, status = 0, [], "empty"
                if x is None:
                    status = "null"
                else:
                    try:
                        _, _, found, us = decode(x)
                    except (ValueError, KeyError, IndexError, TypeError, struct.error) as e:
                        status = f"broken: {type(e).__name__} {e}"
                rows = [(d, k, a, b, a * us // 1000, (b + 1) * us // 1000, "ok") for k, (a, b) in enumerate(found)] or [(d, *[None] * 5, status)]
                for row in rows:
                    for column, v in zip(out, row):
                        column.append(v)
            return out

        return work

    return map_rows(pick(media, "doc_id", "media", types={"doc_id": "bigint", "media": "binary"}), start, CLIP)


def features(docs: DataFrame) -> DataFrame:
    """Stores each text, reads the stored file back and describes it, one row a document; repeated rows stay.

    feature: frames, then shots as first-last frame, then the mean histogram in thousandths. clips: the shots as start-end in milliseconds.
    """

    def one(text: str | None) -> tuple:
        n, payload = padded(text)
        media = write_avi(payload)
        back, h, found, us = decode(media)
        feature = f"{len(h)};{','.join(f'{a}-{b}' for a, b in found)};{','.join(str(int(x)) for x in np.rint(h.mean(axis=0) * 1000))}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, ",".join(f"{a * us // 1000}-{(b + 1) * us // 1000}" for a, b in found)

    def start() -> Callable:
        return lambda doc, text: [doc, *map(list, zip(*map(one, text)))]

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips string"
    return map_rows(pick(docs, "doc_id", "text"), start, schema)
