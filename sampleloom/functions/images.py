"""Image operations on tensor structs: HWC images of bytes, or FHWC videos frame by frame.

Arrow functions over numpy; random decisions are hashes of (seed, row), one for
all frames of a video.  Files are decoded by Spark's own image source (see
:mod:`sampleloom.sources.media`); PNG bytes in memory by the decoder here.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.functions.buffers import row_udf
from sampleloom.shipping import ship
from sampleloom.types import INDEX, TENSOR, require, tensor, untensor

PRESETS = {
    "default": (0.299, 0.587, 0.114),
    "rec601": (0.299, 0.587, 0.114),
    "rec709": (0.2126, 0.7152, 0.0722),
    "rec2020": (0.2627, 0.678, 0.0593),
    "green": (0.0, 1.0, 0.0),
}


def _frames(x: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    if x.ndim == 3:
        return f(x)
    if x.ndim == 4:
        return np.stack([f(v) for v in x])
    raise ValueError("an image has three dimensions, a video four")


def center_crop(x: np.ndarray, w: int, h: int) -> np.ndarray:
    def one(v):
        if v.shape[0] < h or v.shape[1] < w:
            raise ValueError("the crop is larger than the image")
        a, b = (v.shape[0] - h) // 2, (v.shape[1] - w) // 2
        return v[a : a + h, b : b + w]

    return _frames(x, one)


def channel_reduction(x: np.ndarray, preset: str = "default") -> np.ndarray:
    """One channel from three in 16.16 fixed point, cut down and clamped."""
    factors = [int(c * 65536) for c in PRESETS[preset]]

    def one(v):
        if v.shape[2] == 1:
            return v
        total = sum(v[:, :, k].astype(np.int64) * factors[k] for k in range(3)) >> 16
        return np.clip(total, 0, 255).astype(np.uint8)[:, :, None]

    return _frames(x, one)


def _triangle(n_in: int, n_out: int) -> np.ndarray:
    """The n_out x n_in matrix of a triangle filter, wider where it shrinks."""
    scale = n_out / n_in
    support = 1.0 if scale >= 1 else 1.0 / scale
    centre = (np.arange(n_out) + 0.5) / scale - 0.5
    at = np.arange(n_in)
    w = np.maximum(0, 1 - np.abs(at[None, :] - centre[:, None]) / support)
    # beyond the edge the last pixel is repeated
    for i in range(n_out):
        low, high = int(np.floor(centre[i] - support)) + 1, int(np.ceil(centre[i] + support))
        for k in range(low, high):
            if k < 0 or k >= n_in:
                w[i, min(max(k, 0), n_in - 1)] += max(0.0, 1 - abs(k - centre[i]) / support)
    return w / w.sum(1, keepdims=True)


def resize(x: np.ndarray, w: int, h: int) -> np.ndarray:
    """Both sides scaled by a triangle filter."""

    def one(v):
        rows, cols = _triangle(v.shape[0], h), _triangle(v.shape[1], w)
        made = np.einsum("ij,jkc->ikc", rows, v.astype(np.float64))
        made = np.einsum("ij,kjc->kic", cols, made)
        return np.clip(np.floor(made + 0.5), 0, 255).astype(np.uint8)

    return _frames(x, one)


def resize_smallest_side(x: np.ndarray, size: int) -> np.ndarray:
    h, w = x.shape[-3], x.shape[-2]
    scale = size / min(h, w)
    return resize(x, int(np.floor(w * scale + 0.5)), int(np.floor(h * scale + 0.5)))


def rotate(x: np.ndarray, angle: float, crop: bool = False) -> np.ndarray:
    """By so many degrees: each pixel takes the nearest of the original, or zero outside it; with ``crop`` the size stays."""
    rad = np.deg2rad(angle)
    cos, sin = np.cos(rad), np.sin(rad)

    def one(v):
        h, w = v.shape[:2]
        nh, nw = (h, w) if crop else (int(np.ceil(abs(h * cos) + abs(w * sin) - 1e-9)), int(np.ceil(abs(w * cos) + abs(h * sin) - 1e-9)))
        yy, xx = np.mgrid[0:nh, 0:nw]
        dy, dx = yy - (nh - 1) / 2, xx - (nw - 1) / 2
        sx = np.floor(cos * dx + sin * dy + (w - 1) / 2 + 0.5).astype(int)
        sy = np.floor(-sin * dx + cos * dy + (h - 1) / 2 + 0.5).astype(int)
        ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
        out = np.zeros((nh, nw, v.shape[2]), v.dtype)
        out[ok] = v[sy[ok], sx[ok]]
        return out

    return _frames(x, one)


def h_flip(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x[..., ::-1, :])


def random_crop(x: np.ndarray, w: int, h: int, rng: np.random.Generator) -> np.ndarray:
    height, width = x.shape[-3], x.shape[-2]
    if height < h or width < w:
        raise ValueError("the crop is larger than the image")
    a, b = int(rng.integers(0, height - h + 1)), int(rng.integers(0, width - w + 1))
    return np.ascontiguousarray(x[..., a : a + h, b : b + w, :])


def random_area_crop(x: np.ndarray, area_range: tuple[float, float], aspect_ratio_range: tuple[float, float], rng: np.random.Generator, num_trial: int = 10) -> np.ndarray:
    """A crop whose share of the area and aspect ratio are uniform in the ranges; unchanged when no trial fits."""
    height, width = x.shape[-3], x.shape[-2]
    for _ in range(num_trial):
        area = rng.uniform(*area_range) * height * width
        ratio = rng.uniform(*aspect_ratio_range)
        w, h = int(round((area * ratio) ** 0.5)), int(round((area / ratio) ** 0.5))
        if 0 < w <= width and 0 < h <= height:
            return random_crop(x, w, h, rng)
    return x


def image_op(df: DataFrame, key: str, f: Callable, output_key: str = "", seed: int | None = None) -> DataFrame:
    """``f`` of the tensor, and of a random generator for the row where a seed is given."""
    require(df, key)
    ship(df.sparkSession)
    if seed is None:
        udf = row_udf(lambda v: None if v is None else tensor(f(untensor(v))), TENSOR).asNondeterministic()
        return df.withColumn(output_key or key, udf(F.col(f"`{key}`")))
    udf = row_udf(lambda v, row: None if v is None else tensor(f(untensor(v), np.random.default_rng(abs(row)))), TENSOR).asNondeterministic()
    row = F.col(INDEX) if INDEX in df.columns else F.xxhash64(F.col(f"`{key}`.data"))
    return df.withColumn(output_key or key, udf(F.col(f"`{key}`"), F.xxhash64(F.lit(seed), row)))


# ---------------------------------------------------------------- PNG


def decode_png(data: bytes) -> np.ndarray:
    """HWC bytes with three channels (one for gray); 8 bits a sample, not interlaced, alpha dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG: other formats are decoded from files by Spark's image source")
    at, packed, palette = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlace:
                raise ValueError("only PNGs with 8 bits a sample and without interlacing are decoded")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.int32)
    for y in range(h):
        mode, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if mode == 0:
            row = line
        elif mode == 2:
            row = (line + above) & 255
        elif mode == 1:
            row = (np.cumsum(line.reshape(w, channels), axis=0) & 255).ravel()
        else:
            row = line.copy()
            for x in range(w * channels):
                left = row[x - channels] if x >= channels else 0
                corner = above[x - channels] if x >= channels else 0
                if mode == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    pa, pb, pc = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = left if pa <= pb and pa <= pc else above[x] if pb <= pc else corner
                row[x] = (row[x] + guess) & 255
        out[y] = row
        above = row
    image = out.reshape(h, w, channels)
    if colour == 3:
        return palette[image[:, :, 0]]
    return np.ascontiguousarray(image[:, :, :1] if colour == 4 else image[:, :, :3])


def encode_png(x: np.ndarray) -> bytes:
    """HWC bytes with one or three channels as a PNG."""
    h, w, c = x.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = np.zeros((h, 1 + w * c), np.uint8)
    raw[:, 1:] = np.ascontiguousarray(x, np.uint8).reshape(h, w * c)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")
