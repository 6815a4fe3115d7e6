"""Expressions and image kernels on edges, against slow loops written from the specification."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidescore.functions import pixels, scalars
from tidescore.plans.predict import top1

NAN, INF = float("nan"), float("inf")


def slow_top1(values):
    best = 0
    for i, v in enumerate(values):
        if v > values[best]:
            best = i
    total = sum(math.exp(v - values[best]) if math.isfinite(v - values[best]) else (0.0 if v - values[best] == -INF else NAN) for v in values)
    return best, 1 / total


@pytest.mark.parametrize("values", [[1.0, 3.0, 3.0], [0.0], [5.0] * 4, [NAN, 1.0, 2.0], [1.0, NAN, 2.0, 0.5], [1.0, INF, 2.0], [-INF, 0.0], [-1e30, 1e30]])
def test_top1_edges(spark, values):
    row = top1(spark.createDataFrame([(values,)], "logits array<double>")).first()
    index, confidence = slow_top1(values)
    assert row.class_index == index
    assert row.confidence == pytest.approx(confidence, nan_ok=True)


def test_top1_of_nothing(spark):
    rows = top1(spark.createDataFrame([([],), (None,)], "logits array<float>")).collect()
    assert [(r.class_index, r.confidence) for r in rows] == [(None, None)] * 2


def test_split_rows(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], 2), ([1.0, 2.0, 3.0], 2), ([], 0)], "flat array<double>, n int")
    assert [r[0] for r in frame.select(scalars.split_rows(F.col("flat"), F.col("n"), 2)).collect()] == [[[1.0, 2.0], [3.0, 4.0]], None, None]


def test_sizes(spark):
    frame = spark.createDataFrame([(1546, 1213), (335, 500), (100, 100), (1, 9), (256, 256)], "w int, h int")
    s, d = scalars.choose_scale(F.col("w"), F.col("h")), scalars.resized_dims(F.col("w"), F.col("h"))
    rows = frame.select(s["num"], s["den"], d["w"], d["h"]).collect()
    assert [tuple(r) for r in rows] == [(1, 4, 326, 256), (7, 8, 256, 382), (1, 1, 256, 256), (1, 1, 256, 2304), (1, 1, 256, 256)]
    for r, (w, h) in zip(rows, [(1546, 1213), (335, 500), (100, 100), (1, 9), (256, 256)], strict=True):
        assert (r[0], r[1]) == pixels.scale_for(w, h) and (r[2], r[3]) == pixels.resized(w, h)


def test_small_expressions(spark):
    one = spark.range(1)
    got = one.select(
        scalars.floor32(F.lit(-0.25)), scalars.clamp(F.lit(-3), 0, 255), scalars.ns_to_ms_by_us(F.lit(1_999_999)), scalars.halved_dim(F.lit(1213), F.lit(3)), scalars.parse_ints(F.lit(" 1, x,2.5,-3 ,+4,99999999999999999999,")),
        scalars.backend_name(F.lit(9)), scalars.device_label(F.lit(50)), scalars.device_label(F.lit(51)), scalars.input_error(F.lit(None).cast("array<float>")), scalars.one_of(["a", "b"], F.lit(3)),
    ).first()
    assert list(got) == [-1, 0, 1.999, 152, [1, -3, 4], "backend(9)", "cpu", "cuda", f"input length 0, want {scalars.INPUT_LENGTH}", "b"]


def slow_bilinear(p, w, h):
    out = np.zeros((h, w, p.shape[2]), np.uint8)
    for y in range(h):
        sy = (y + 0.5) * p.shape[0] / h - 0.5
        y0 = math.floor(sy)
        for x in range(w):
            sx = (x + 0.5) * p.shape[1] / w - 0.5
            x0 = math.floor(sx)
            at = lambda j, i: p[min(max(j, 0), p.shape[0] - 1), min(max(i, 0), p.shape[1] - 1)].astype(float)
            mix = lambda a, b, t: a + (b - a) * t
            v = mix(mix(at(y0, x0), at(y0, x0 + 1), sx - x0), mix(at(y0 + 1, x0), at(y0 + 1, x0 + 1), sx - x0), sy - y0)
            out[y, x] = np.clip(np.floor(v + 0.5), 0, 255)
    return out


@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 14), st.integers(1, 14), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_bilinear(h, w, out_h, out_w, seed):
    p = np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)
    assert np.abs(pixels.bilinear(p, out_w, out_h).astype(int) - slow_bilinear(p, out_w, out_h)).max() <= 1  # a tie may round either way


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 2), (8, 8), (256, 300)])
def test_modes_agree(shape):
    p = np.random.default_rng(0).integers(0, 256, (*shape, 3)).astype(np.uint8)
    a, b = pixels.preprocess(p, "default"), pixels.preprocess(p, "turbo")
    assert a.shape == b.shape == (3, 224, 224) and a.dtype == b.dtype == np.float32
    assert np.abs(a - b).max() <= 0.51 / 255 / 0.224 + 1e-5
    with pytest.raises(ValueError, match="unknown mode"):
        pixels.preprocess(p, "other")


@given(st.integers(1, 12), st.integers(1, 12), st.sampled_from([1, 3, 4]), st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_png(h, w, c, seed):
    p = np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(np.uint8)
    assert np.array_equal(pixels.decode_png(pixels.encode_png(p)), p)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    """Lines filtered by the definitions, read back."""
    import zlib

    p = np.random.default_rng(kind).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    flat, lines = p.reshape(4, 15).astype(int), []
    for y in range(4):
        up, row = (flat[y - 1] if y else np.zeros(15, int)), flat[y]
        left = np.concatenate([np.zeros(3, int), row[:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        near = [min((a, b, c), key=lambda v, a=a, b=b, c=c: abs(a + b - c - v)) for a, b, c in zip(left, up, corner, strict=True)]
        lines.append(bytes([kind]) + ((row - [0, left, up, (left + up) // 2, np.array(near)][kind]) & 255).astype(np.uint8).tobytes())
    good = pixels.encode_png(p)
    at = good.index(b"IDAT") - 4
    body = zlib.compress(b"".join(lines))
    made = good[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + good[good.index(b"IEND") - 4 :]
    assert np.array_equal(pixels.decode_png(made), p)


@pytest.mark.parametrize("content", [b"", b"not an image", b"\x89PNG\r\n\x1a\n", b"\x89PNG\r\n\x1a\n\0\0\0\x05IDATxxxxx\0\0\0\0"])
def test_broken_pictures(content):
    with pytest.raises(pixels.DecodeError):
        pixels.decode_png(content)


def test_alpha_and_grey():
    rgba = np.array([[[200, 100, 50, 128], [9, 9, 9, 0], [7, 8, 9, 255]]], np.uint8)
    assert pixels.to_rgb(rgba).tolist() == [[[100, 50, 25], [0, 0, 0], [7, 8, 9]]]
    assert pixels.to_rgb(np.array([[[5]]], np.uint8)).tolist() == [[[5, 5, 5]]]


def test_shrink():
    p = np.arange(16, dtype=np.uint8).reshape(4, 4, 1)
    assert pixels.shrink(p, 1, 2)[..., 0].tolist() == [[3, 5], [11, 13]]
    assert pixels.shrink(p, 1, 8).shape == (1, 1, 1) and np.array_equal(pixels.shrink(p, 1, 1), p)
