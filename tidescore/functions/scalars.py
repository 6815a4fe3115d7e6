"""Scalar and array expressions of scoring. All are native columns, so Catalyst can fold, push down and compile them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS, SIDE, CLASSES = 3, 224, 1000
SHORT_SIDE = 256
#: Values of a model's input row.
INPUT_LENGTH = CHANNELS * SIDE * SIDE
MAX_BODY_BYTES = 20 * 1024 * 1024

# Per-channel mean and deviation of the model's training images.
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)

# Scales that a decoder offers, smallest first.
SCALES = ((1, 8), (1, 4), (3, 8), (1, 2), (5, 8), (3, 4), (7, 8), (1, 1))

# Names of decode backends by number.
BACKENDS = {0: "DEFAULT", 1: "HYBRID(cpu-huffman)", 2: "GPU_HYBRID(cuda-cores)", 3: "HARDWARE(nvjpg-engine)"}


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def floor32(x: Column) -> Column:
    """Floor to a whole number, towards minus infinity also for negative coordinates."""
    return F.floor(x).cast("int")


def argmax_first(logits: Column) -> Column:
    """Index of the first largest value. A NaN in front wins, and any other NaN is passed over; null if there are no values."""
    first = F.get(logits, F.lit(0))
    real = F.filter(logits, lambda v: ~F.isnan(v.cast("double")))
    return F.when(F.size(logits) < 1, F.lit(None)).when(F.isnan(first.cast("double")), F.lit(0)).otherwise(F.array_position(logits, F.array_max(real)) - 1).cast("int")


def softmax_of_max(logits: Column) -> Column:
    """Softmax probability of the largest value; NaN if any value is NaN or the largest is infinite.

    Differences are taken in the logits' own precision, exponentials and their sum in doubles.
    """
    any_nan = F.exists(logits, lambda v: F.isnan(v.cast("double")))
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda v: F.exp((v - top).cast("double"))), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(logits) < 1, F.lit(None)).when(any_nan | (F.abs(top.cast("double")) == float("inf")), F.lit(float("nan"))).otherwise(1.0 / total)


def input_error(values: Column, length: int = INPUT_LENGTH) -> Column:
    """An error text for inputs of another length, else null."""
    size = F.when(values.isNull(), F.lit(0)).otherwise(F.size(values))
    return F.when(size != length, F.concat(F.lit("input length "), size.cast("string"), F.lit(f", want {length}")))


def resized_dims(w: Column, h: Column, short_side: int = SHORT_SIDE) -> Column:
    """(w, h) with the shorter side at short_side; halves round up."""
    scaled = lambda long, short: F.floor(F.lit(float(short_side)) * long / short + 0.5).cast("int")
    return F.struct(F.when(w < h, short_side).otherwise(scaled(w, h)).cast("int").alias("w"), F.when(w < h, scaled(h, w)).otherwise(short_side).cast("int").alias("h"))


def crop_offset(size: Column, side: int = SIDE) -> Column:
    return F.floor((size - side) / 2).cast("int")


def choose_scale(w: Column, h: Column, target: int = SHORT_SIDE) -> Column:
    """The smallest decoder scale (num, den) whose shorter side is at least the target, else 1/1."""
    short = F.least(w, h)
    out = F.lit(None)
    for num, den in reversed(SCALES):
        side = F.floor((short * num + den - 1) / den)
        out = F.when(side >= target, F.struct(F.lit(num).alias("num"), F.lit(den).alias("den"))).otherwise(out if (num, den) != (1, 1) else F.struct(F.lit(1).alias("num"), F.lit(1).alias("den")))
    return out


def scaled_dim(full: Column, num, den) -> Column:
    """A side after decoding at num / den, rounded up."""
    return F.floor((full * num + den - 1) / den).cast("int")


def halved_dim(full: Column, scale: Column) -> Column:
    """A side after halving it scale times, rounded up."""
    den = F.call_function("shiftleft", F.lit(1), scale)
    return F.floor((full + den - 1) / den).cast("int")


def ns_to_ms(ns: Column) -> Column:
    return ns / F.lit(1e6)


def ns_to_ms_by_us(ns: Column) -> Column:
    """Milliseconds after cutting to whole microseconds."""
    us = F.when(ns >= 0, F.floor(ns / 1000)).otherwise(F.ceil(ns / 1000))
    return us / F.lit(1000.0)


def backend_name(number: Column) -> Column:
    out = F.concat(F.lit("backend("), number.cast("string"), F.lit(")"))
    for k, v in BACKENDS.items():
        out = F.when(number == k, F.lit(v)).otherwise(out)
    return out


def device_label(memory_delta_mib: Column) -> Column:
    return F.when(memory_delta_mib > 50, F.lit("cuda")).otherwise(F.lit("cpu"))


def parse_ints(text: Column) -> Column:
    """Whole numbers of a comma-separated list; tokens that aren't one are passed over."""
    tokens = F.transform(F.split(text, ","), lambda t: F.trim(t, F.lit(" \t\r\n")))
    good = F.filter(tokens, lambda t: t.rlike(r"^[+-]?[0-9]+$"))
    return F.filter(F.transform(good, lambda t: t.try_cast("bigint")), lambda v: v.isNotNull())


def split_rows(flat: Column, n: Column, width) -> Column:
    """An array of n rows of a row-major array; null if its length isn't n * width."""
    rows = F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(flat, (i - 1) * width + 1, F.lit(width)))
    return F.when((n > 0) & (F.size(flat) == n * width), rows)


def one_of(values: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))
