"""Motion-JPEG in AVI: a writer that keeps bytes losslessly, a reader, and shots by histogram differences.

*Writer.* A payload byte is one quantised coefficient of a baseline JPEG: of size category 8, whose 256
values (-255..-128, 128..255) stand for the 256 bytes. Entropy coding of quantised coefficients loses
nothing, so 64 bytes are one 8 x 8 block. All symbols are (run 0, size 8) under a code of 8 zero bits,
and every block is followed by a restart marker, so each coefficient takes two bytes at a known place
and both coding and decoding are array operations.

*Reader.* Any AVI with an ``idx1`` index and baseline grey or colour JPEG frames without subsampling of
the first component: chunks are found by the index, frames by Huffman decoding. Frames of the writer's
own form take the array path; all others a general decoder, symbol by symbol.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from hashlib import sha256

import numpy as np

#: Frames are SIDE x SIDE pixels, BLOCKS blocks; FPS frames a second.
SIDE, FPS = 32, 25
BLOCKS = SIDE * SIDE // 64
#: Where the k-th coded coefficient of a block lies in its rows.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HUFFMAN = bytes([0] * 7 + [1] + [0] * 8 + [8])  # one code of 8 bits, for symbol 8
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _HUFFMAN)
    + _segment(0xC4, b"\x10" + _HUFFMAN)
    + _segment(0xDD, b"\0\1")
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
_RESTARTS = np.array([0xD0 + i % 8 for i in range(BLOCKS)], np.uint8)


_BLOCK_BYTES = 64 * 3 + 2  # code, value, room for a stuffed zero; then the marker


def _write_frames(values: np.ndarray) -> list[bytes]:
    """values: uint8 of frames x BLOCKS x 64."""
    n = len(values)
    coded = np.zeros((n, BLOCKS, _BLOCK_BYTES), np.uint8)
    kept = np.ones((n, BLOCKS, _BLOCK_BYTES), bool)
    coded[:, :, 1:192:3] = values
    kept[:, :, 2:192:3] = values == 255  # 0xFF is followed by a stuffed zero
    coded[:, :, 192], coded[:, :, 193] = 0xFF, _RESTARTS
    kept[:, -1, 192:] = False
    ends = np.cumsum(np.count_nonzero(kept, axis=(1, 2))).tolist()
    body = coded[kept].tobytes()
    return [_HEAD + body[i:j] + b"\xff\xd9" for i, j in zip([0, *ends], ends)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI that holds ``payload``, whose length (kept in a ``strd`` chunk) is a positive multiple of 64."""
    frames = -(-len(payload) // (BLOCKS * 64))
    values = np.zeros(frames * BLOCKS * 64, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    coded = _write_frames(values.reshape(frames, BLOCKS, 64))
    movi, index, at = [b"movi"], [], 4
    for x in coded:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        movi.append(_chunk(b"00dc", x))
        at += len(movi[-1])
    most = max(map(len, coded))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, frames, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload)))
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    frame_seconds: float
    frames: list[bytes]
    payload_bytes: int | None


def _walk(data: bytes, at: int, end: int) -> list[bytes]:
    """The frames of a ``movi`` list in their order, those in its ``rec `` lists too."""
    frames = []
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST":  # its parts come next
            at += 12
            continue
        if name[2:] in (b"dc", b"db"):
            frames.append(data[at + 8 : min(end, at + 8 + n)])
        at += 8 + n + (n & 1)
    return frames


def read_avi(data: bytes) -> Avi:
    """Header and frames of an AVI, the frames by its ``idx1`` index (offsets from the ``movi`` list's name or
    from the file's start, as both are in use); of a file without index all that its list holds. Raises ValueError on what isn't such a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    seconds, movi, index, size = 0.0, None, b"", None
    stack = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi, last = at + 8, min(end, at + 8 + n)
                else:
                    stack.append((at + 12, min(end, at + 8 + n)))
            elif name == b"avih":
                seconds = struct.unpack_from("<I", data, at + 8)[0] / 1e6
            elif name == b"strd" and n == 8:
                size = struct.unpack_from("<Q", data, at + 8)[0]
            elif name == b"idx1":
                index = data[at + 8 : at + 8 + n]
            at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("no movi list")
    frames, base = [] if index else _walk(data, movi + 4, last), None
    for name, _, offset, n in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
        if name[2:] not in (b"dc", b"db"):
            continue
        if base is None:
            base = movi if data[movi + offset : movi + offset + 4] == name else 0
        frames.append(data[base + offset + 8 : base + offset + 8 + n])
    return Avi(seconds, frames, size)


def _tables(body: bytes, tables: dict) -> None:
    at = 0
    while at < len(body):
        key, counts = body[at], body[at + 1 : at + 17]
        at += 17
        code, table = 0, {}
        for bits, count in enumerate(counts, 1):
            for _ in range(count):
                table[bits, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        tables[key] = table


def _decode_own(frames: list[bytes]) -> np.ndarray | None:
    """Coefficients of frames in the writer's form, of all blocks in order; None if one isn't in that form.
    Without the zeros stuffed after 0xFF each block has 128 bytes and a marker of 2."""
    if not all(x.startswith(_HEAD) for x in frames):
        return None
    body = np.frombuffer(b"".join([x[len(_HEAD) :] for x in frames]), np.uint8)
    plain = np.ones(len(body), bool)
    at = np.flatnonzero(body[:-1] == 0xFF) + 1
    plain[at[body[at] == 0]] = False
    plain = body[plain]
    if len(plain) != len(frames) * BLOCKS * 130:
        return None
    blocks = plain.reshape(-1, 130)
    if blocks[:, :128:2].any() or (blocks[:, 128] != 0xFF).any():
        return None
    values = blocks[:, 1:128:2].astype(np.int16)
    values[values < 128] -= 255
    return values


def decode_coefficients(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Quantised coefficients (blocks x 64, zigzag order) of the first component, its quantisation table,
    and the frame's width and height."""
    own = _decode_own([jpeg])
    if own is not None:
        return own, np.ones(64), SIDE, SIDE
    return _decode_general(jpeg)


def _decode_general(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, dict] = {}
    at, interval, parts, width, height = 2, 0, [], 0, 0
    while True:
        if jpeg[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = jpeg[at + 1]
        n = struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                kind = ">u2" if wide else "u1"
                quant[body[i] & 15] = np.frombuffer(body, kind, 64, i + 1).astype(float)
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC0:
            _, height, width, count = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(count)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames can be read")
        elif marker == 0xC4:
            _tables(body, tables)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = {body[1 + 2 * c]: body[2 + 2 * c] for c in range(body[0])}
            break
    if any((h, v) != (parts[0][1], parts[0][2]) and (h > parts[0][1] or v > parts[0][2]) for _, h, v, _ in parts):
        raise ValueError("the first component is subsampled")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    if not width or not height or not all(1 <= x <= 4 for _, h, v, _ in parts for x in (h, v)):
        raise ValueError("a frame without pixels, or of impossible sampling factors")
    across, down = -(-width // (8 * parts[0][1])), -(-height // (8 * parts[0][2]))
    # A block takes two bits at least, so a header can't ask for more blocks than its data may hold.
    if across * down * parts[0][1] * parts[0][2] > 4 * (len(jpeg) - at) + 4:
        raise ValueError("the frame is larger than its data")
    end = jpeg.rfind(b"\xff\xd9")
    coded = jpeg[at : end if end >= at else len(jpeg)]
    pieces, last, i = [], 0, coded.find(b"\xff")
    while i >= 0 and i + 1 < len(coded):
        if 0xD0 <= coded[i + 1] <= 0xD7:
            pieces.append(coded[last:i])
            last = i + 2
        i = coded.find(b"\xff", i + 2)
    pieces.append(coded[last:])
    h, v = parts[0][1], parts[0][2]
    out = np.zeros((down * v, across * h, 64), np.int16)
    mcu = 0
    for piece in pieces:
        raw = piece.replace(b"\xff\x00", b"\xff")
        bits, left = int.from_bytes(raw, "big"), 8 * len(raw)
        total = left

        def take(n: int) -> int:
            nonlocal left
            left -= n
            return (bits >> left) & ((1 << n) - 1) if left >= 0 else 0

        def symbol(table: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("no such code")

        def number(size: int) -> int:
            x = take(size)
            return x if size == 0 or x >> (size - 1) else x - (1 << size) + 1

        before = dict.fromkeys(scan, 0)
        for _ in range(interval or across * down):
            if mcu >= across * down or left > total:
                break
            for c, (name, ch, cv, _) in enumerate(parts):
                dc, ac = tables[scan[name] >> 4], tables[16 | scan[name] & 15]
                for y in range(cv):
                    for x in range(ch):
                        block = np.zeros(64, np.int16)
                        before[name] += number(symbol(dc))
                        block[0], k = before[name], 1
                        while k < 64:
                            s = symbol(ac)
                            if s == 0:
                                break
                            k += s >> 4
                            if s & 15:
                                block[k] = number(s & 15)
                            k += 1
                        if c == 0:
                            out[mcu // across * v + y, mcu % across * h + x] = block
            mcu += 1
    return out.reshape(-1, 64), quant[parts[0][3]], width, height


_c = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.5), 1) / 2
#: From 64 coefficients in zigzag order to 64 pixels.
_INVERSE = np.einsum("xu,yv->uvxy", _c, _c).reshape(64, 64)[ZIGZAG].astype(np.float32)


def pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """uint8 of blocks x 64."""
    flat = (coefficients * quant.astype(np.float32)) @ _INVERSE
    flat += 128.5
    return np.clip(flat, 0, 255, out=flat).astype(np.uint8)


BINS = 16


def histograms(grey: np.ndarray, frames: int) -> np.ndarray:
    """Shares of BINS grey levels, one row a frame."""
    per = grey.reshape(frames, -1)
    at = (per >> 4).astype(np.int64) + BINS * np.arange(frames)[:, None]
    return np.bincount(at.ravel(), minlength=frames * BINS).reshape(frames, BINS) / per.shape[1]


def shots(histogram: np.ndarray, window: int = 12, factor: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """[first, end) frames of each shot. A cut lies where the histogram difference to the frame before is over
    ``least`` and over mean + factor * deviation of the up to ``window`` differences on either side."""
    frames = len(histogram)
    if not frames:
        return []
    d = np.abs(np.diff(histogram, axis=0)).sum(1) / 2
    n = len(d)
    one, two = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    low, high = np.maximum(np.arange(n) - window, 0), np.minimum(np.arange(n) + window + 1, n)
    count = np.maximum(high - low - 1, 1)
    mean = (one[high] - one[low] - d) / count
    var = np.maximum((two[high] - two[low] - d * d) / count - mean * mean, 0)
    cuts = [0, *(np.flatnonzero((d > least) & (d > mean + factor * np.sqrt(var))) + 1).tolist(), frames]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def clip_rows(data: bytes) -> list[tuple[int, float, float, int, list[float]]]:
    """(clip, start second, end second, frames, mean histogram) of each shot of an AVI."""
    avi = read_avi(data)
    rows = []
    for frame in avi.frames:
        c, quant, *_ = decode_coefficients(frame)
        rows.append(histograms(pixels(c, quant), 1)[0])
    h = np.array(rows).reshape(-1, BINS)
    return [(i, a * avi.frame_seconds, b * avi.frame_seconds, b - a, h[a:b].mean(0).tolist()) for i, (a, b) in enumerate(shots(h))]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def read_payload(data: bytes) -> tuple[bytes, np.ndarray]:
    """(the stored bytes, the histograms of the frames) of an AVI that ``write_avi`` made."""
    avi = read_avi(data)
    c = _decode_own(avi.frames)
    if c is None:
        c = np.concatenate([decode_coefficients(x)[0] for x in avi.frames])
    stored = np.where(c > 0, c, c + 255).astype(np.uint8).tobytes()[: avi.payload_bytes]
    return stored, histograms(pixels(c, np.ones(64)), len(avi.frames))


def digest(text: str | None) -> tuple:
    """The row of a text: sizes and hashes of payload and media, the features of the decoded frames."""
    n, payload = payload_of(text)
    media = write_avi(payload)
    stored, h = read_payload(media)
    cut = shots(h)
    longest = max(b - a for a, b in cut)
    feature = f"frames={len(h)};seconds={len(h) / FPS:.2f};shots={len(cut)};longest={longest};hist=" + ",".join(str(int(x)) for x in np.rint(h.mean(0) * 1000))
    return n, len(stored), sha256(stored).hexdigest(), zlib.crc32(stored[-64:]), len(media), sha256(media).hexdigest(), feature
