"""Image kernels in numpy, for use inside Arrow batches; only the pixels that a result needs are read.

Pictures are uint8 arrays (height, width, channels). Two modes agree on decisions, not on every bit: "rounded" resizes to
bytes and then crops and normalises; "fused" computes the cropped pixels alone, without the rounding. Results are float32,
as models take them, and so is their arithmetic; another kind of float may be asked for.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from tidescore.functions.scalars import MEAN, SCALES, SHORT_SIDE, SIDE, STD

MODES = ("rounded", "fused")
#: Other names under which the modes are known: hardware decoders compute the same picture.
ALIASES = {"default": "rounded", "gpu": "rounded", "gpu-pooled": "rounded", "turbo": "fused", "cpu": "fused"}


def tile(values: list[int] | None, *shape: int) -> np.ndarray:
    """A vector of bytes as a picture. One that lacks pixels is of floats, with NaN for these, which the kernels keep; pixels beyond the shape go."""
    size = math.prod(shape)
    values = (values or [])[:size]
    if len(values) == size:
        return np.array(values, np.uint8).reshape(shape)
    out = np.full(size, np.nan)
    out[: len(values)] = values
    return out.reshape(shape)


class DecodeError(ValueError):
    """Bytes that are no picture this library reads."""


def image_format(content: bytes) -> str | None:
    return "jpeg" if content[:3] == b"\xff\xd8\xff" else "png" if content[:8] == b"\x89PNG\r\n\x1a\n" else None


def resized(w: int, h: int, short_side: int = SHORT_SIDE) -> tuple[int, int]:
    if w < h:
        return short_side, int(short_side * h / w + 0.5)
    return int(short_side * w / h + 0.5), short_side


def taps(size: int, out: int, start: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two source places and the weight of the second one, for `count` results from `start` on."""
    at = (np.arange(start, start + count) + 0.5) * (size / out) - 0.5
    low = np.floor(at)
    weight = at - low  # of the place before it is held inside the picture
    low = low.astype(np.int64)
    return np.clip(low, 0, size - 1), np.clip(low + 1, 0, size - 1), weight


def _between(near: np.ndarray, far: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return near + (far - near) * weight


def _blend(near: np.ndarray, far: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return near * (1 - weight) + far * weight


def _resample(picture: np.ndarray, w: int, h: int, box: tuple[int, int, int, int], mix, kind) -> np.ndarray:
    """A box (left, top, columns, rows) of the picture resized to (h, w): along source lines first, then between them."""
    left, top, columns, rows = box
    x0, x1, fx = taps(picture.shape[1], w, left, columns)
    y0, y1, fy = taps(picture.shape[0], h, top, rows)
    lines = picture[y0[0] : y1[-1] + 1]
    across = mix(lines[:, x0].astype(kind), lines[:, x1].astype(kind), fx.astype(kind)[None, :, None])
    return mix(across[y0 - y0[0]], across[y1 - y0[0]], fy.astype(kind)[:, None, None])


def bilinear(picture: np.ndarray, w: int, h: int, box: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Resized to (h, w), or a box (left, top, columns, rows) of that, rounded to bytes."""
    made = np.clip(np.floor(_resample(picture, w, h, box or (0, 0, w, h), _between, np.float64) + 0.5), 0, 255)
    return made.astype(np.uint8) if picture.dtype == np.uint8 else made


def normalise(picture: np.ndarray, mean=MEAN, std=STD, kind=np.float32) -> np.ndarray:
    """(channels, height, width) of a cropped picture. Bytes are looked up, as they have 256 results a channel."""
    mean, std = np.asarray(mean, kind), np.asarray(std, kind)
    if picture.dtype == np.uint8:
        results = (np.arange(256, dtype=kind)[:, None] / kind(255) - mean) / std
        return np.stack([results[:, c][picture[..., c]] for c in range(len(mean))])
    scaled = (picture.astype(kind) / kind(255) - mean) / std
    return np.ascontiguousarray(scaled.transpose(2, 0, 1))


def middle(w: int, h: int, side: int) -> tuple[int, int, int, int]:
    """The box that a centre crop keeps."""
    return (w - side) // 2, (h - side) // 2, side, side


def fused(picture: np.ndarray, short_side: int = SHORT_SIDE, side: int = SIDE, mean=MEAN, std=STD, kind=np.float32) -> np.ndarray:
    """Resize, crop and normalise at once: the cropped results only, not rounded in between."""
    w, h = resized(picture.shape[1], picture.shape[0], short_side)
    return normalise(_resample(picture, w, h, middle(w, h, side), _blend, kind), mean, std, kind)


def preprocess(picture: np.ndarray, mode: str = "rounded", short_side: int = SHORT_SIDE, side: int = SIDE, mean=MEAN, std=STD, kind=np.float32) -> np.ndarray:
    """The model's input of a picture with as many channels as mean has."""
    mode = ALIASES.get(mode, mode)
    if mode == "fused":
        return fused(picture, short_side, side, mean, std, kind)
    if mode != "rounded":
        raise ValueError(f"unknown mode {mode!r}")
    w, h = resized(picture.shape[1], picture.shape[0], short_side)
    return normalise(bilinear(picture, w, h, middle(w, h, side)), mean, std, kind)


def premultiply(rgba: np.ndarray) -> np.ndarray:
    """RGB of straight RGBA, each colour times its alpha, in 16-bit steps and cut to a byte."""
    if rgba.dtype != np.uint8:
        return np.where(np.isnan(rgba[..., :3] + rgba[..., 3:]), np.nan, premultiply(np.nan_to_num(rgba).astype(np.uint8)))
    wide = rgba.astype(np.uint32) * 0x101
    return ((wide[..., :3] * wide[..., 3:] // 0xFFFF) >> 8).astype(np.uint8)


def to_rgb(picture: np.ndarray) -> np.ndarray:
    """Three channels of a grey, RGB or straight RGBA picture."""
    if picture.shape[2] == 1:
        return np.repeat(picture, 3, axis=2)
    return premultiply(picture) if picture.shape[2] == 4 else picture


def from_spark_image(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB of Spark's image source, whose bytes are grey, BGR or BGRA."""
    if height < 1 or width < 1:
        raise DecodeError("not a picture")
    picture = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels >= 3:
        picture = picture[..., [2, 1, 0, *range(3, channels)]]
    return to_rgb(picture)


def shrink(picture: np.ndarray, num: int, den: int) -> np.ndarray:
    """A decoder's scaled picture: sides rounded up, each result the mean of the pixels it covers."""
    h, w = (-(-s * num // den) for s in picture.shape[:2])
    edge = lambda n, out: np.minimum(np.arange(out) * den // num, n - 1)
    out = np.add.reduceat(picture.astype(np.float64), edge(picture.shape[0], h), axis=0)
    out = np.add.reduceat(out, edge(picture.shape[1], w), axis=1)
    rows = np.diff([*edge(picture.shape[0], h), picture.shape[0]])
    columns = np.diff([*edge(picture.shape[1], w), picture.shape[1]])
    made = np.floor(out / (np.maximum(rows, 1)[:, None, None] * np.maximum(columns, 1)[None, :, None]) + 0.5)
    return made if picture.dtype == np.float64 else made.astype(np.uint8)


def scale_for(w: int, h: int, target: int = SHORT_SIDE) -> tuple[int, int]:
    short = min(w, h)
    return next(((n, d) for n, d in SCALES if -(-short * n // d) >= target), (1, 1))


def encode_png(picture: np.ndarray) -> bytes:
    """An 8-bit PNG of a grey, RGB or RGBA picture."""
    h, w, c = picture.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.zeros((h, 1 + w * c), np.uint8)
    raw[:, 1:] = picture.reshape(h, w * c)
    kind = {1: 0, 3: 2, 4: 6}[c]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(content: bytes) -> np.ndarray:
    """Grey, RGB or RGBA pixels of an 8-bit PNG that is not interlaced; other kinds are read by Spark's image source."""
    if image_format(content) != "png":
        raise DecodeError("not a PNG")
    at, data, head, palette = 8, [], None, None
    try:
        while at < len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            body = content[at + 8 : at + 8 + size]
            at += 12 + size
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                data.append(body)
        w, h, depth, colour, _, _, interlaced = head
        channels = {0: 1, 2: 3, 3: 1, 6: 4}[colour]
        if depth != 8 or interlaced:
            raise DecodeError("this kind of PNG is not supported")
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * channels)
    except (struct.error, zlib.error, TypeError, KeyError, ValueError) as e:
        raise DecodeError(f"broken PNG: {e}") from e
    picture = _unfilter(raw[:, 0], raw[:, 1:].reshape(h, w, channels))
    return palette[picture[..., 0]] if colour == 3 else picture


def _unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Pixels of filtered lines. Where a line's filter needs its left and upper pixels, all lines advance together along diagonals."""
    h, w, channels = lines.shape
    out = np.zeros((h + 1, w + 1, channels), np.uint8)  # with a line above and a pixel on the left
    if (kinds <= 2).all():
        for y, kind in enumerate(kinds.tolist()):
            out[y + 1, 1:] = np.cumsum(lines[y], axis=0, dtype=np.uint8) if kind == 1 else lines[y] + out[y, 1:] if kind == 2 else lines[y]
        return out[1:, 1:]
    for d in range(w + h - 1):
        y = np.arange(max(0, d - w + 1), min(h - 1, d) + 1)
        x = d - y
        left, up, corner = (out[a, b].astype(np.int16) for a, b in ((y + 1, x), (y, x + 1), (y, x)))
        near = left + up - corner
        by_left, by_up, by_corner = np.abs(near - left), np.abs(near - up), np.abs(near - corner)
        paeth = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        kind = kinds[y, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, paeth], 0)
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:]
