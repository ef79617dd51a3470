"""From page images to their texts: decode, turn upright, scale, enhance, and read the whole page and its zone."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import crop_zone, prepare_page, protect_size, upright
from .jpeg import decode_jpeg

#: Fixed value: characters that an engine may read on primary documents.
ZONE_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<"

#: A plane of height, width and channels from a file's bytes; text of a plane, of the characters given or of any.
Decoder = Callable[[bytes], np.ndarray]
PlaneReader = Callable[[np.ndarray, str | None], str]

_TEXTS = "struct<full_text:string,mrz_text:string,text_error:string>"


def unfiltered(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of a PNG, the first byte of each its filter, as plain bytes; width: bytes of a pixel."""
    out = np.zeros((rows.shape[0] + 1, rows.shape[1] - 1 + width), dtype=np.int64)  # with an empty row and pixel before
    for y, row in enumerate(rows, 1):
        kind, line = int(row[0]), row[1:].astype(np.int64)
        if kind in (0, 2):
            out[y, width:] = (line + (out[y - 1, width:] if kind else 0)) & 255
            continue
        for x in range(0, len(line), width):
            left, up, corner = out[y, x : x + width], out[y - 1, x + width : x + 2 * width], out[y - 1, x : x + width]
            if kind == 1:
                guess = left
            elif kind == 3:
                guess = (left + up) // 2
            else:
                near = np.abs(left + up - corner - np.stack([left, up, corner]))
                guess = np.choose(near.argmin(axis=0), [left, up, corner])
            out[y, x + width : x + 2 * width] = (line[x : x + width] + guess) & 255
    return out[1:, width:].astype(np.uint8)


def decode_png(content: bytes) -> np.ndarray:
    """A plane of red, green and blue, with alpha if the file has it: 8 bits a channel, not interlaced."""
    at, data, head = 8, [], None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("Unable to load image.")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    protect_size(w, h)
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(h, w * channels + 1)
    plane = unfiltered(rows, channels).reshape(h, w, channels)
    return plane if channels > 2 else np.concatenate([np.repeat(plane[..., :1], 3, axis=2), plane[..., 1:]], axis=2)


#: By the first bytes of a file. WebP and GIF, and progressive JPEG files, take a decoder of the caller's.
DECODERS: dict[bytes, Decoder] = {b"\x89PNG": decode_png, b"\xff\xd8\xff": decode_jpeg}


def load_image(content: bytes | str, decoders: dict[bytes, Decoder] | None = None) -> np.ndarray:
    """The plane of a file's bytes or of a data URL, upright."""
    if isinstance(content, str):
        if not content.startswith("data:") or ";base64," not in content:
            raise ValueError("Invalid image data.")
        content = base64.b64decode(content.partition(";base64,")[2])
    for magic, decode in {**DECODERS, **(decoders or {})}.items():
        if content.startswith(magic):
            plane = decode(content)
            protect_size(plane.shape[1], plane.shape[0])
            return upright(content, plane)
    raise ValueError("Unable to load image.")


def read_page_texts(pages: DataFrame, engine: PlaneReader | None, primary: bool = True, decoders: dict[bytes, Decoder] | None = None, image_col: str = "image") -> DataFrame:
    """pages with full_text, mrz_text and text_error: what engine reads on each page, and on its zone if it is a primary one.

    On primary pages only ZONE_CHARACTERS are read. Without an engine, or where it fails, texts are empty; an image that is
    null, can't be decoded or is too large has empty texts and says why. Each image is decoded once, by the task that has it.
    """

    def read(plane: np.ndarray) -> str:
        try:
            return engine(plane, ZONE_CHARACTERS if primary else None) or "" if engine else ""
        except Exception:  # as a missing engine: no text
            return ""

    def one(image: bytes | None) -> tuple[str, str, str | None]:
        if image is None:
            return "", "", "No image."
        try:
            plane = load_image(image, decoders)
            return read(prepare_page(plane)), read(crop_zone(plane)) if primary else "", None
        except Exception as e:  # a broken image is a row with an error, not the end of the job
            return "", "", str(e)

    @F.pandas_udf(_TEXTS)
    def texts(images: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in images], columns=["full_text", "mrz_text", "text_error"])

    found = pages.withColumn("__texts", texts(F.col(image_col)))
    return found.withColumns({c: F.col("__texts")[c] for c in ("full_text", "mrz_text", "text_error")}).drop("__texts")
