"""Baseline JPEG files as planes: Huffman codes, dequantisation, the inverse cosine transform, and chroma taken to full size.

Codes are read one block after the other, as each begins where the one before ends; everything after that is done for all blocks
of a component at once.
"""

from __future__ import annotations

import struct

import numpy as np

from .images import protect_size, resize

#: Where the k-th coefficient of a block in the file stands in it, row by row: diagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: The cosine transform of 8 values as a matrix, whose transpose is its inverse.
_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
UNREADABLE = "Unable to load image."


class _Codes:
    """A Huffman table by the next 16 bits: length of the code, and its value."""

    def __init__(self, counts: bytes, values: bytes):
        self.length, self.value = bytearray(1 << 16), bytearray(1 << 16)
        code, k = 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                a, b = code << (16 - n), (code + 1) << (16 - n)
                if b > 1 << 16:
                    raise ValueError(UNREADABLE)
                self.length[a:b], self.value[a:b] = bytes([n]) * (b - a), values[k : k + 1] * (b - a)
                code, k = code + 1, k + 1
            code <<= 1


class _Bits:
    """The bits of a scan; behind its end all are 0."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            more = self.data[self.at : self.at + 8]
            self.at += 8
            self.held = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(more.ljust(8, b"\0"), "big")
            self.n += 64

    def code(self, codes: _Codes) -> int:
        self.need(16)
        next_bits = self.held >> (self.n - 16) & 0xFFFF
        length = codes.length[next_bits]
        if not length:
            raise ValueError(UNREADABLE)
        self.n -= length
        return codes.value[next_bits]

    def number(self, size: int) -> int:
        """A number of so many bits; those that begin with 0 are negative."""
        if not size:
            return 0
        self.need(size)
        self.n -= size
        x = self.held >> self.n & ((1 << size) - 1)
        return x if x >> (size - 1) else x - (1 << size) + 1


def _segments(content: bytes):
    """(marker, body, place behind it) of each segment up to and with the first scan's head."""
    at = 2
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise ValueError(UNREADABLE)
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        yield marker, content[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size
        if marker == 0xDA:
            return


def _scan_parts(data: bytes) -> list[bytes]:
    """The scan's bytes between restarts, without the zeros that stand behind each FF."""
    parts, begin, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            parts.append(data[begin:])
            break
        after = data[at + 1]
        if after == 0 or after == 0xFF:
            at += 2 if after == 0 else 1
        elif 0xD0 <= after <= 0xD7:
            parts.append(data[begin:at])
            begin = at = at + 2
        else:
            parts.append(data[begin:at])
            break
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


def decode_jpeg(content: bytes) -> np.ndarray:
    """A plane of red, green and blue. Baseline and extended sequential files of 8 bits, grey or in colour, in one scan; others
    (progressive, arithmetic, four components) raise ValueError."""
    tables, codes, frame, restart, adobe, order, at = {}, {}, None, 0, None, None, 0
    for marker, body, end in _segments(content):
        if marker == 0xDB:
            p = 0
            while p < len(body):
                wide, number = body[p] >> 4, body[p] & 15
                size = 128 if wide else 64
                tables[number] = np.frombuffer(body[p + 1 : p + 1 + size], dtype=">u2" if wide else np.uint8).astype(np.float64)
                p += 1 + size
        elif marker == 0xC4:
            p = 0
            while p < len(body):
                counts = body[p + 1 : p + 17]
                codes[body[p]] = _Codes(counts, body[p + 17 : p + 17 + sum(counts)])
                p += 17 + sum(counts)
        elif marker in (0xC0, 0xC1):
            bits, h, w, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or n not in (1, 3):
                raise ValueError(UNREADABLE)
            frame = h, w, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(UNREADABLE)
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            order, at = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])], end
    if frame is None or order is None or len(order) != len(frame[2]):
        raise ValueError(UNREADABLE)
    h, w, parts = frame
    protect_size(w, h)
    if len(parts) == 1:  # a component alone isn't interleaved, whatever its sampling
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-w // (8 * most_h)), -(-h // (8 * most_v))
    coefficients = _coefficients(_scan_parts(content[at:]), parts, order, codes, across * down, restart)
    planes = []
    for (_, ph, pv, q), blocks in zip(parts, coefficients):
        flat = np.zeros((len(blocks), 64))
        flat[:, ZIGZAG] = blocks * tables[q]
        pixels = np.clip(np.rint(_COS.T @ flat.reshape(-1, 8, 8) @ _COS + 128), 0, 255)
        grid = pixels.reshape(down, across, pv, ph, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * pv * 8, across * ph * 8)
        grid = grid[: -(-h * pv // most_v), : -(-w * ph // most_h)]
        whole = grid.shape == (h, w)
        planes.append(grid if whole else resize(grid.astype(np.uint8)[..., None], w, h)[..., 0].astype(np.float64))
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[..., None], 3, axis=2)
    if adobe == 0:
        return np.stack(planes, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    colours = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(colours), 0, 255).astype(np.uint8)


def _coefficients(scan: list[bytes], parts: list, order: list, codes: dict, units: int, restart: int) -> list[np.ndarray]:
    """The blocks of each component, units one after the other, coefficients as they stand in the file."""
    out = [np.zeros((units * ph * pv, 64)) for _, ph, pv, _ in parts]
    place = {part[0]: i for i, part in enumerate(parts)}
    try:
        plan = [(place[c], codes[dc], codes[16 + ac], parts[place[c]][1] * parts[place[c]][2]) for c, dc, ac in order]
    except KeyError:
        raise ValueError(UNREADABLE) from None
    done = [0] * len(parts)
    for k, data in enumerate(scan):
        bits, before = _Bits(data), [0] * len(parts)
        first = k * restart
        for _ in range(first, min(first + restart, units) if restart else units):
            for i, dc, ac, blocks in plan:
                for _ in range(blocks):
                    block = out[i][done[i]]
                    done[i] += 1
                    before[i] += bits.number(bits.code(dc))
                    block[0] = before[i]
                    at = 1
                    while at < 64:
                        run = bits.code(ac)
                        if run == 0:  # the rest is 0
                            break
                        at += run >> 4
                        if run & 15:
                            if at > 63:
                                raise ValueError(UNREADABLE)
                            block[at] = bits.number(run & 15)
                        at += 1
            if bits.at - 64 > len(data):  # the scan breaks off: what is left stays grey
                return out
    return out
