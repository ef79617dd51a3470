"""The structure of PDF files: objects, wherever they stand, the page tree with what pages inherit, and images on pages.

Objects are found by the file's cross-reference tables and streams, back through all its revisions, and inside compressed object
streams. A file whose references are damaged is searched for its objects instead. Only what is asked for is parsed.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ocr import unfiltered

#: Depth of nested arrays and page tree nodes at most, bytes that one stream may unpack to, and pages of a file.
MOST_DEPTH, MOST_STREAM, MOST_FILE_PAGES = 100, 256 << 20, 100_000
#: Fixed value: the page that is meant where a file names no box, in points.
DEFAULT_BOX = (0.0, 0.0, 612.0, 792.0)

PAGES = "array<struct<page:int,width:double,height:double,rotate:int>>"


class Ref(tuple):
    """(number, generation) of another object."""


class Name(str):
    pass


@dataclass
class Stream:
    head: dict
    raw: bytes


_SPACE = rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*"
_TOKEN = re.compile(_SPACE + rb"(<<|>>|\[|\]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\x00\t\n\x0c\r ]*>|(\d+)" + rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z])|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+)")
_STREAM = re.compile(_SPACE + rb"stream(\r\n|\n|\r)")
_NUMBERED = rb"(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj"
_OBJECT, _AT_OBJECT = re.compile(rb"(?<![0-9])" + _NUMBERED), re.compile(_SPACE + _NUMBERED)
_TABLE = re.compile(_SPACE + rb"(\d+)[ ]+(\d+)[\x00\t\n\x0c\r ]+")


def _string_end(data: bytes, at: int) -> int:
    depth = 1
    while depth:
        m = re.compile(rb"[()\\]").search(data, at)
        if m is None:
            raise ValueError("string without end")
        at = m.end() + (m[0] == b"\\")
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
    return at


def parse(data: bytes, at: int = 0, depth: int = 0):
    """(value, place behind it) of the object at a place. Strings are bytes as they stand, None is null or no value."""
    if depth > MOST_DEPTH:
        raise ValueError("objects too deep")
    m = _TOKEN.match(data, at)
    if m is None:
        raise ValueError(f"no object at {at}")
    token, at = m[1], m.end()
    if m[2]:
        return Ref((int(m[2]), int(m[3]))), at
    if token == b"<<":
        out: dict = {}
        while True:
            key, at = parse(data, at, depth + 1)
            if key is _END:
                return out, at
            value, at = parse(data, at, depth + 1)
            if value is _END:
                return out, at
            out[str(key)] = value
    if token == b"[":
        items = []
        while True:
            value, at = parse(data, at, depth + 1)
            if value is _END:
                return items, at
            items.append(value)
    if token in (b">>", b"]"):
        return _END, at
    if token == b"(":
        end = _string_end(data, at)
        return data[at : end - 1], end
    if token[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), token[1:]).decode("latin-1")), at
    if token[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if token[:1] in b"+-.0123456789":
        return (float(token) if b"." in token else int(token)), at
    return {b"true": True, b"false": False}.get(token), at


_END = object()


def _rows(data: bytes, width: int, pixel: int) -> bytes:
    """Rows of `width` bytes, each with a PNG filter before it, as plain bytes; pixel: bytes of a pixel."""
    n = len(data) // (width + 1)
    rows = np.frombuffer(data[: n * (width + 1)], dtype=np.uint8).reshape(n, width + 1)
    return unfiltered(rows, pixel).tobytes()


class Pdf:
    def __init__(self, content: bytes):
        if not content.startswith(b"%PDF-"):
            raise ValueError("no PDF file")
        self.data, self.made = content, {}
        #: Object number -> place in the file, or (number of an object stream, place in it).
        self.places: dict[int, int | tuple[int, int]] = {}
        self.trailer: dict = {}
        try:
            self._references()
            if not isinstance(self.get(self.get(self.trailer.get("Root")).get("Pages")), dict):
                raise ValueError("no page tree")
        except (ValueError, AttributeError, KeyError, IndexError, struct.error, zlib.error):
            self._search()
        if "Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")

    def _references(self) -> None:
        m = re.search(rb"startxref\s+(\d+)\D*$", self.data[-2048:])
        if m is None:
            raise ValueError("no startxref")
        todo, seen = [int(m[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            table = re.compile(_SPACE + rb"xref").match(self.data, at)
            if table:
                head = self._table(table.end())
                todo += [head[k] for k in ("XRefStm", "Prev") if isinstance(head.get(k), int)]
            else:
                stream = self._object(at)
                head = stream.head
                self._reference_stream(stream)
                todo += [head["Prev"]] if isinstance(head.get("Prev"), int) else []
            self.trailer = {**head, **self.trailer}  # what stands later in the file counts

    def _table(self, at: int) -> dict:
        while True:
            m = _TABLE.match(self.data, at)
            if m is None:
                break
            first, n, at = int(m[1]), int(m[2]), m.end()
            for i in range(n):
                line = self.data[at : at + 20]
                if line[17:18] == b"n":
                    self.places.setdefault(first + i, int(line[:10]))
                else:
                    self.places.setdefault(first + i, -1)
                at += 20
        m = re.compile(_SPACE + rb"trailer").match(self.data, at)
        if m is None:
            raise ValueError("no trailer")
        return parse(self.data, m.end())[0]

    def _reference_stream(self, stream: Stream) -> None:
        widths = [int(w) for w in stream.head["W"]]
        data, size = self.unpacked(stream), sum(widths)
        index = stream.head.get("Index") or [0, stream.head["Size"]]
        at = 0
        for first, n in zip(index[::2], index[1::2]):
            for i in range(n):
                row, fields, p = data[at : at + size], [], 0
                if len(row) < size:
                    return
                for w in widths:
                    fields.append(int.from_bytes(row[p : p + w], "big"))
                    p += w
                kind = fields[0] if widths[0] else 1
                self.places.setdefault(first + i, fields[1] if kind == 1 else (fields[1], fields[2]) if kind == 2 else -1)
                at += size

    def _search(self) -> None:
        """All objects that the file holds in the open, and those in its object streams; later ones count."""
        self.places, self.made, self.trailer = {}, {}, {}
        for m in _OBJECT.finditer(self.data):
            self.places[int(m[1])] = m.start()
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.trailer |= parse(self.data, m.end())[0]
            except (ValueError, TypeError):
                continue
        for number in list(self.places):
            try:
                found = self.get(Ref((number, 0)))
                if isinstance(found, Stream) and found.head.get("Type") == "ObjStm":
                    for i, (inner, _) in enumerate(self._members(found)):
                        self.places.setdefault(inner, (number, i))
                head = found.head if isinstance(found, Stream) else found
                if isinstance(head, dict) and head.get("Type") in ("Catalog", "XRef") and "Root" not in self.trailer:
                    self.trailer["Root"] = head.get("Root", Ref((number, 0)))
            except (ValueError, KeyError, TypeError, zlib.error):
                continue
        if "Root" not in self.trailer:
            for number in list(self.places):
                found = self.get(Ref((number, 0)))
                if isinstance(found, dict) and found.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref((number, 0))

    def _object(self, at: int):
        """The object whose `n g obj` stands at a place."""
        m = _AT_OBJECT.match(self.data, at)
        if m is None:
            raise ValueError(f"no object at {at}")
        value, at = parse(self.data, m.end())
        m = _STREAM.match(self.data, at)
        if not isinstance(value, dict) or m is None:
            return value
        size = self.get(value.get("Length"))
        end = m.end() + size if isinstance(size, int) and 0 <= size else -1
        if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
            end = self.data.find(b"endstream", m.end())
            if end < 0:
                raise ValueError("stream without end")
        return Stream(value, self.data[m.end() : end])

    def _members(self, stream: Stream) -> list[tuple[int, int]]:
        data = self.unpacked(stream)
        n, first = self.get(stream.head["N"]), self.get(stream.head["First"])
        numbers = [int(x) for x in data[:first].split()[: 2 * n]]
        return [(number, first + at) for number, at in zip(numbers[::2], numbers[1::2])]

    def get(self, value):
        """What a reference leads to; other values as they are."""
        hops = 0
        while isinstance(value, Ref) and hops < MOST_DEPTH:
            number, hops = value[0], hops + 1
            if number not in self.made:
                self.made[number] = None  # an object that needs itself is null
                place = self.places.get(number, -1)
                if isinstance(place, tuple):
                    stream = self.get(Ref((place[0], 0)))
                    at = dict(self._members(stream)).get(number)
                    self.made[number] = None if at is None else parse(self.unpacked(stream), at)[0]
                elif place >= 0:
                    self.made[number] = self._object(place)
            value = self.made[number]
        return value

    def unpacked(self, stream: Stream, stop: tuple[str, ...] = ()) -> bytes:
        """A stream's bytes without its filters, up to one of `stop`."""
        filters = self.get(stream.head.get("Filter")) or []
        settings = self.get(stream.head.get("DecodeParms")) or []
        filters, settings = (x if isinstance(x, list) else [x] for x in (filters, settings))
        data = stream.raw
        for i, kind in enumerate(self.get(f) for f in filters):
            if kind in stop:
                break
            if kind not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {kind}")
            unpack = zlib.decompressobj()
            data = unpack.decompress(data, MOST_STREAM)
            if unpack.unconsumed_tail:
                raise ValueError("stream too large")
            how = (self.get(settings[i]) if i < len(settings) else None) or {}
            if how.get("Predictor", 1) >= 10:
                pixel = max(1, how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8)
                data = _rows(data, (how.get("Colors", 1) * how.get("BitsPerComponent", 8) * how.get("Columns", 1) + 7) // 8, pixel)
            elif how.get("Predictor", 1) != 1:
                raise ValueError("unknown predictor")
        return data

    def pages(self) -> list[dict]:
        """The pages in order, each with the entries that it inherits."""
        out: list[dict] = []
        root = self.get(self.trailer.get("Root")) or {}
        stack = [(root.get("Pages"), {}, frozenset())]
        while stack and len(out) < MOST_FILE_PAGES:
            ref, above, path = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or ref in path or len(path) > MOST_DEPTH:
                continue
            own = above | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                path = path | {ref} if isinstance(ref, Ref) else path
                stack += [(k, own, path) for k in reversed(kids)]
            else:
                out.append(node | own)
        return out

    def size(self, page: dict) -> tuple[float, float, int]:
        """Width and height in points as the page is shown, and how it is turned: 0, 90, 180 or 270 degrees."""

        def box(name: str) -> tuple | None:
            found = self.get(page.get(name))
            found = [self.get(x) for x in found] if isinstance(found, list) else []
            if len(found) != 4 or not all(isinstance(x, (int, float)) for x in found):
                return None
            return min(found[0], found[2]), min(found[1], found[3]), max(found[0], found[2]), max(found[1], found[3])

        media = box("MediaBox") or DEFAULT_BOX
        crop = box("CropBox") or media
        shown = (max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3]))
        if shown[2] <= shown[0] or shown[3] <= shown[1]:
            shown = media
        turned = self.get(page.get("Rotate")) or 0
        turned = int(turned) // 90 * 90 % 360 if isinstance(turned, (int, float)) else 0
        w, h = float(shown[2] - shown[0]), float(shown[3] - shown[1])
        return (h, w, turned) if turned in (90, 270) else (w, h, turned)

    def image(self, page: dict) -> bytes | None:
        """The largest image on a page as a file: JPEG as it stands, plain pixels as PNG; None if there is none of these. Pages that
        were scanned hold one, and need no engine to be drawn."""
        resources = self.get(page.get("Resources")) or {}
        named = self.get(resources.get("XObject")) or {}
        found = [s for s in map(self.get, named.values()) if isinstance(s, Stream) and s.head.get("Subtype") == "Image"]
        found.sort(key=lambda s: -(self.get(s.head.get("Width")) or 0) * (self.get(s.head.get("Height")) or 0))
        for s in found:
            kinds = self.get(s.head.get("Filter")) or []
            kinds = [self.get(k) for k in kinds] if isinstance(kinds, list) else [kinds]
            if kinds and kinds[-1] in ("DCTDecode", "DCT"):
                return self.unpacked(s, ("DCTDecode", "DCT"))
            channels = {"DeviceRGB": 3, "DeviceGray": 1}.get(self.get(s.head.get("ColorSpace")))
            w, h = self.get(s.head.get("Width")), self.get(s.head.get("Height"))
            if channels and self.get(s.head.get("BitsPerComponent")) == 8:
                data = self.unpacked(s)
                if len(data) >= w * h * channels:
                    return encode_png(np.frombuffer(data[: w * h * channels], dtype=np.uint8).reshape(h, w, channels))
        return None


def encode_png(plane: np.ndarray) -> bytes:
    """A PNG file of a plane of one or three channels."""
    h, w, channels = plane.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), plane.reshape(h, -1)], axis=1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def page_sizes(content: bytes | None) -> list[tuple[int, float, float, int]] | None:
    """(page, width, height, rotate) of a file's pages; None if it is no PDF, or none can be read."""
    if content is None:
        return None
    try:
        file = Pdf(bytes(content))
        return [(i, *file.size(p)) for i, p in enumerate(file.pages(), 1)] or None
    except Exception:  # a broken file has no pages; the job goes on
        return None


def pdf_pages(content: Column) -> Column:
    """page_sizes() as a column."""

    @F.pandas_udf(PAGES)
    def sizes(files: pd.Series) -> pd.Series:
        names = ("page", "width", "height", "rotate")
        return pd.Series([None if found is None else [dict(zip(names, p)) for p in found] for found in map(page_sizes, files)])

    return sizes(content)


def pdf_page_count(content: Column) -> Column:
    """Pages of a PDF, also where they are compressed; null if it can't be read."""
    pages = pdf_pages(content)
    return F.when(pages.isNotNull(), F.size(pages))
