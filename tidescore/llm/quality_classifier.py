"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text gives a short vector of statistics. Standardised over all documents, they pass random cosine features, whose
inner products approximate a Gaussian kernel. Each partition adds up its own normal equations of the labelled rows; the
sums, whose size depends on the number of features alone, are solved by ridge regression. The raw score is calibrated by
isotonic regression over a fixed grid of score bins, in which all labelled rows are counted.

Labelled rows whose crc32(doc_id) mod 5 is 0 take no part in either fit.

Defined cases: null text is empty and scored like any other; null labels are ignored; a document with several labels
counts once for each; without labelled rows every score is 0.5; null ids match no label and count as crc32 of the empty
text; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.llm import common

STATISTICS = (
    "log_words", "log_chars", "word_length", "symbol_share", "exclaim_share", "upper_share", "digit_share", "punctuation_share", "wide_share", "space_share",
    "distinct_words", "top_word", "repeated_next", "log_lines", "repeated_lines",
)
FEATURES = 192
SEED = 9
#: Width of the kernel in standard deviations of a statistic, times the root of their number; statistics are cut at this many.
WIDTH, CUT = 0.7, 4.0
RIDGE = 1e-4
BINS, LOW, HIGH = 4096, -0.5, 1.5
FOLDS, HELD_OUT = 5, 0
PREDICTED_FROM = 0.3

_CLASSES = np.zeros((256, 7), np.float64)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (_c in "#*$%&|<>", _c == "!", "A" <= _c <= "Z", "0" <= _c <= "9", _c in ".,;:?\"'()-", _b >= 128, _c in " \t\n\r\x0b\x0c")


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text; every one is finite, also for the empty text."""
    raw = text.encode()
    words = raw.split()
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES) / max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(len(words)), np.log1p(len(raw)), sum(map(len, words)) / n, *shares,
        len(counts) / n, max(counts.values(), default=0) / n, same / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in common.slices(batches, 1):
            rows = [statistics(common.text_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, x array<double>")


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing weighted least-squares fit of y over sorted x, by pooling neighbours that fall."""
    blocks: list[list[float]] = []  # weight, weighted y, weighted x
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([w, w * b, w * a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    pooled = np.array(blocks)
    return pooled[:, 2] / pooled[:, 0], pooled[:, 1] / pooled[:, 0]


class Model:
    """mean, deviation of the statistics; ridge weights; calibration knots."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 0, deviation, 1.0)
        self.directions = rng.normal(0, 1 / (WIDTH * np.sqrt(len(STATISTICS))), (len(STATISTICS), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.deviation, -CUT, CUT)
        waves = np.sqrt(2 / FEATURES) * np.cos(scaled @ self.directions + self.phases)
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def _rows(batch, at: int = 0) -> np.ndarray:
    column = batch.column(at)
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS)) if len(column) else np.zeros((0, len(STATISTICS)))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats: (id, x), read three times; labels: (doc_id, quality)."""
    k = len(STATISTICS)
    moments = stats.agg(*[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    model = Model(np.array([moments[f"m{i}"] or 0.0 for i in range(k)]), np.array([moments[f"d{i}"] or 0.0 for i in range(k)]))
    known = labels.where(F.col("quality").isNotNull() & (common.crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    train = stats.join(known, F.col("id") == F.col("_id")).select("x", "y")
    size = FEATURES + 1

    def add_up(batches):
        square, cross, met = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            z, y = model.features(_rows(batch)), batch.column(1).to_numpy()
            square += z.T @ z
            cross += z.T @ y
            met += len(y)
        if met:
            flat = np.concatenate([square.ravel(), cross])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "value"])

    sums = train.mapInArrow(add_up, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # (FEATURES + 1) * (FEATURES + 2) rows
    if not sums:
        return model
    flat = np.zeros(size * (size + 1))
    flat[[r.cell for r in sums]] = [r.value for r in sums]
    square, cross = flat[: size * size].reshape(size, size), flat[size * size :]
    penalty = np.full(size, RIDGE * square[-1, -1])
    penalty[-1] = 0
    model.weights = np.linalg.solve(square + np.diag(penalty), cross)

    def tally(batches):
        bins = np.zeros((2, BINS))
        for batch in batches:
            at = np.clip(((model.raw(_rows(batch)) - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            bins += [np.bincount(at, minlength=BINS), np.bincount(at, batch.column(1).to_numpy(), minlength=BINS)]
        met = np.flatnonzero(bins[0])
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(bins[0, met]), pa.array(bins[1, met])], ["bin", "n", "good"])

    counted = sorted(train.mapInArrow(tally, "bin bigint, n double, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect())  # at most BINS rows
    x, n, good = np.array([tuple(r) for r in counted]).T
    model.knots = isotonic(LOW + (x + 0.5) * (HIGH - LOW) / BINS, good / n, n)
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    common.checkpoint_folder(docs.sparkSession)
    stats = document_statistics(docs, id_col, text_col).checkpoint()
    model = fit(stats, labels)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in batches:
            score = model.score(_rows(batch, 1))
            arrays = [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= PREDICTED_FROM).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    frame = stats.select("id", "x", (common.crc_mod(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"))
    return frame.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
