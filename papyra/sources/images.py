"""Pixels: orientation, size, contrast, and the crop of a zone. Planes are numpy arrays of height, width and channels."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from papyra.config import MAX_PIXELS, OCR_WIDTH

#: Contrast and lift of a page; weights of channels, contrast, white and black of a zone; crop and its scale.
PAGE_CONTRAST, PAGE_LIFT = 1.18, 8
GREY, ZONE_CONTRAST, WHITE_FROM, BLACK_TO = (0.299, 0.587, 0.114), 1.85, 170, 90
ZONE_SHARE, ZONE_SCALE = 0.45, 3


def clamp(values: np.ndarray) -> np.ndarray:
    """As bytes, rounded to the nearest, halves to even."""
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def protect_size(width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise ValueError("Invalid image size.")
    if width * height > MAX_PIXELS:
        raise ValueError("Image is too large.")


def enhance_contrast(plane: np.ndarray) -> np.ndarray:
    out = plane.copy()
    out[..., :3] = clamp((plane[..., :3].astype(np.float64) - 128) * PAGE_CONTRAST + 128 + PAGE_LIFT)
    return out


@lru_cache(32)
def weights(size: int, target: int) -> np.ndarray:
    """A matrix that takes a line of `size` pixels to one of `target`, whose rows sum to 1.

    Smaller: each new pixel is the mean of what it covers, with the share of pixels that it covers in part. Larger: each lies
    between the two nearest pixel centres, and at an edge is the pixel there.
    """
    if target < size:
        edges = np.arange(target + 1) * (size / target)
        left, right = edges[:-1, None], edges[1:, None]
        at = np.arange(size)[None, :]
        covered = np.clip(np.minimum(right, at + 1) - np.maximum(left, at), 0, None)
        return covered / covered.sum(axis=1, keepdims=True)
    centre = np.clip((np.arange(target) + 0.5) * (size / target) - 0.5, 0, size - 1)
    low = np.minimum(np.floor(centre).astype(np.int64), max(size - 2, 0))
    out = np.zeros((target, size))
    rows = np.arange(target)
    out[rows, low] += 1 - (centre - low)
    out[rows, np.minimum(low + 1, size - 1)] += centre - low
    return out


#: Rows and columns of a matrix of weights that are held at once.
STRIP = 256


def _along(plane: np.ndarray, target: int) -> np.ndarray:
    """plane with its first axis taken to `target`, in strips whose weights touch few of the rows."""
    matrix, parts = weights(plane.shape[0], target), []
    for a in range(0, target, STRIP):
        part = matrix[a : a + STRIP]
        used = np.flatnonzero(part.any(axis=0))
        rows = plane[used[0] : used[-1] + 1]
        parts.append(np.tensordot(part[:, used[0] : used[-1] + 1], rows, axes=(1, 0)))
    return np.concatenate(parts)


def resize(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """A plane of another size: rows and columns apart, each by means of areas where it shrinks and between centres where it grows."""
    out = plane.astype(np.float64)
    if height != plane.shape[0]:
        out = _along(out, height)
    if width != plane.shape[1]:
        out = _along(out.transpose(1, 0, 2), width).transpose(1, 0, 2)
    return clamp(out)


def prepare_page(plane: np.ndarray) -> np.ndarray:
    """At most OCR_WIDTH wide, with contrast."""
    h, w = plane.shape[:2]
    scale = min(1.0, OCR_WIDTH / w)
    width, height = round(w * scale), round(h * scale)
    protect_size(width, height)
    return enhance_contrast(resize(plane, width, height) if scale < 1 else plane)


def enhance_zone(plane: np.ndarray) -> np.ndarray:
    """Grey, with strong contrast, near-white as white and near-black as black."""
    grey = plane[..., :3].astype(np.float64) @ np.array(GREY)
    grey = (grey - 128) * ZONE_CONTRAST + 128
    grey = np.where(grey > WHITE_FROM, 255, np.where(grey < BLACK_TO, 0, grey))
    out = plane.copy()
    out[..., :3] = clamp(grey)[..., None]
    return out


def crop_zone(plane: np.ndarray) -> np.ndarray:
    """The lowest part of a page, enlarged and enhanced."""
    h, w = plane.shape[:2]
    top = int(h * (1 - ZONE_SHARE))
    part = plane[top:]
    protect_size(w * ZONE_SCALE, part.shape[0] * ZONE_SCALE)
    return enhance_zone(resize(part, w * ZONE_SCALE, part.shape[0] * ZONE_SCALE))


def exif_orientation(jpeg: bytes) -> int:
    """1 to 8 as the file says, 1 if it says nothing. The value is read where the format keeps it, inside its entry."""
    if jpeg[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF:
        marker, size = jpeg[at + 1], struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0" and len(body) >= 14:
            tiff = body[6:]
            order = "<" if tiff[:2] == b"II" else ">"
            first = struct.unpack(order + "I", tiff[4:8])[0]
            if first + 2 > len(tiff):
                return 1
            for i in range(struct.unpack(order + "H", tiff[first : first + 2])[0]):
                entry = tiff[first + 2 + 12 * i : first + 14 + 12 * i]
                if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
                    value = struct.unpack(order + "H", entry[8:10])[0]
                    return value if 1 <= value <= 8 else 1
            return 1
        if marker == 0xDA:
            break
        at += 2 + size
    return 1


def orient(plane: np.ndarray, orientation: int) -> np.ndarray:
    """The plane upright."""
    turned = {
        2: lambda p: p[:, ::-1],
        3: lambda p: p[::-1, ::-1],
        4: lambda p: p[::-1],
        5: lambda p: p.swapaxes(0, 1),
        6: lambda p: np.rot90(p, -1),
        7: lambda p: p.swapaxes(0, 1)[::-1, ::-1],
        8: lambda p: np.rot90(p),
    }
    return np.ascontiguousarray(turned.get(orientation, lambda p: p)(plane))


def upright(jpeg: bytes, plane: np.ndarray) -> np.ndarray:
    """The plane turned as its file says; as it is if that can't be read."""
    try:
        return orient(plane, exif_orientation(jpeg))
    except Exception:  # a broken header leaves the image as it is
        return plane
