"""Language identification with a byte convolutional network, trained in numpy.

Text bytes are cut into fixed-length windows. Each byte has an embedding; filters of several widths run over the window,
the maximum over places of each filter passes a rectifier, and a softmax layer gives the languages. A document's
probabilities are the softmax of its windows' mean logits, so the whole text counts.

Training takes every language, and of each at most TRAIN_DOCS_PER_LANG labelled documents, or its part of TRAIN_DOCS where there are
many languages (one at least), chosen by a hash among those whose crc32(id) mod 4 is not 2, and at most TRAIN_WINDOWS windows of each, spread evenly over the text. Both are
parameters of the fit alone; prediction reads every byte.

Defined cases: null text and text without a letter are `und` with score 0; without training rows every text is `und`;
bytes past the end of a short window are zero; null ids count as held in; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidescore.llm import common

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
TRAIN_DOCS_PER_LANG = 600
TRAIN_WINDOWS = 4
#: Documents learned from in all, shared by the languages; reached from 64 languages on.
TRAIN_DOCS = 64 * TRAIN_DOCS_PER_LANG
#: Documents of a language that the draw below aims at three times of at the least, so that it never misses a language.
LEAST_DRAWN = 12
EPOCHS = 12
BATCH = 64
RATE = 0.01
SEED = 11
FOLDS, HELD_OUT = 4, 2
#: Windows that a worker runs through the network at once.
WINDOWS_AT_ONCE = 512
#: The pipeline rejects a document below this probability.
MIN_SCORE = 0.4


def has_letter(text: str) -> bool:
    """Whether a character's Unicode category is one of letters; number forms and signs like a half or a circled one are none."""
    return any(map(str.isalpha, text))


def windows_of(text: str) -> np.ndarray:
    """All of a text's bytes as rows of LENGTH, the last one filled up with zeros."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, -(-len(raw) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, LENGTH)


class Network:
    """Weights: embedding (256, E); per width w filters (w * E, F) and bias; output (F * widths, languages) and bias."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.weights = {"embedding": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))), "out_b": np.zeros(len(languages))}
        for w in WIDTHS:
            self.weights |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)), f"b{w}": np.zeros(FILTERS)}
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        self.tables: dict[int, list[np.ndarray]] | None = None

    def forward(self, x: np.ndarray):
        """Logits, and what the backward pass needs."""
        p = self.weights
        embedded = p["embedding"][x]
        kept, tops = {}, []
        for w in WIDTHS:
            n = LENGTH - w + 1
            columns = np.concatenate([embedded[:, i : i + n] for i in range(w)], axis=2)
            maps = columns @ p[f"f{w}"]
            place = maps.argmax(axis=1)
            top = np.take_along_axis(maps, place[:, None], 1)[:, 0] + p[f"b{w}"]
            kept[w] = columns, place, top
            tops.append(np.maximum(top, 0))
        features = np.concatenate(tops, axis=1)
        return features @ p["out"] + p["out_b"], (features, kept)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        logits, (features, kept) = self.forward(x)
        d = np.exp(logits - logits.max(axis=1, keepdims=True))
        d /= d.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        out = {"out": features.T @ d, "out_b": d.sum(axis=0), "embedding": np.zeros_like(p["embedding"])}
        back = d @ p["out"].T
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            columns, place, top = kept[w]
            g = back[:, k * FILTERS : (k + 1) * FILTERS] * (top > 0)
            picked = columns[rows, place]  # (batch, F, w * E)
            out[f"f{w}"] = np.einsum("bfe,bf->ef", picked, g)
            out[f"b{w}"] = g.sum(axis=0)
            into = g[:, :, None] * p[f"f{w}"].T[None]
            for i in range(w):
                np.add.at(out["embedding"], x[rows, place + i], into[:, :, i * EMBEDDING : (i + 1) * EMBEDDING])
        return out

    def train(self, x: np.ndarray, y: np.ndarray) -> "Network":
        """Adam over shuffled batches, from a fixed seed."""
        rng = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for s in range(0, len(x), BATCH):
                pick = order[s : s + BATCH]
                step += 1
                for k, g in self.gradients(x[pick], y[pick]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rate = RATE * (1 - epoch / EPOCHS)
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def compiled(self) -> dict[int, list[np.ndarray]]:
        """A filter's response as a sum of one table lookup for each pair of its bytes: the convolution without a product."""
        if self.tables is None:
            p = self.weights
            self.tables = {}
            for w in WIDTHS:
                single = [p["embedding"] @ p[f"f{w}"][i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(w)]
                pairs = [(single[i][:, None] + single[i + 1][None]).reshape(65536, FILTERS) for i in range(0, w - 1, 2)]
                self.tables[w] = pairs + ([single[-1]] if w % 2 else [])
        return self.tables

    def logits(self, x: np.ndarray) -> np.ndarray:
        """As forward's, by tables, for any number of windows."""
        p, tables, out = self.weights, self.compiled(), []
        for s in range(0, len(x), WINDOWS_AT_ONCE):
            part = x[s : s + WINDOWS_AT_ONCE]
            pairs = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            tops = []
            for w in WIDTHS:
                n = LENGTH - w + 1
                maps = tables[w][0][pairs[:, :n]]
                for k, table in enumerate(tables[w][1:], 1):
                    index = pairs[:, 2 * k : 2 * k + n] if len(table) > 256 else part[:, 2 * k : 2 * k + n]
                    maps += table[index]
                tops.append(np.maximum(maps.max(axis=1) + p[f"b{w}"], 0))
            out.append(np.concatenate(tops, axis=1) @ p["out"] + p["out_b"])
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, probability) of each text."""
        spoken = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        result: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not spoken:
            return result
        cut = [windows_of(texts[i]) for i in spoken]
        starts = np.cumsum([0, *map(len, cut)])
        sums = np.add.reduceat(self.logits(np.concatenate(cut)).astype(np.float64), starts[:-1], axis=0)
        means = sums / np.diff(starts)[:, None]
        chance = np.exp(means - means.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        for i, row in zip(spoken, chance, strict=True):
            result[i] = self.languages[int(row.argmax())], float(row.max())
        return result


def training_rows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, language numbers and languages of the bounded sample."""
    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0) & (common.crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language, as the network's last layer
    if not counts:
        return np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), []
    # a share of each language by a hash, three times what is needed, so that few rows leave their partition
    draw = 1 << 30
    most = min(TRAIN_DOCS_PER_LANG, max(1, TRAIN_DOCS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r.lang, min(draw, 3 * max(most, LEAST_DRAWN) * draw // r.n)) for r in counts], "lang string, share long")
    raw = F.col("text").cast("binary")
    last = F.greatest(F.lit(0), F.octet_length(raw) - LENGTH)
    pieces = F.array(*[F.substring(raw, (F.floor(last * k / max(1, TRAIN_WINDOWS - 1)) + 1).cast("int"), F.lit(LENGTH)) for k in range(TRAIN_WINDOWS)])
    drawn = learn.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(draw)) < F.col("share"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "w")
    sample = drawn.select("lang", "h", "doc_id", F.array_distinct(pieces).alias("w")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    found = sample.orderBy("lang", "r").select("lang", "w").collect()  # at most TRAIN_DOCS rows, or one a language, of TRAIN_WINDOWS * LENGTH bytes
    languages = sorted({r.lang for r in found})
    number = {lang: i for i, lang in enumerate(languages)}
    x = [bytes(w).ljust(LENGTH, b"\0") for r in found for w in r.w if has_letter(bytes(w).decode(errors="ignore"))]
    y = [number[r.lang] for r in found for w in r.w if has_letter(bytes(w).decode(errors="ignore"))]
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, LENGTH), np.array(y, np.int64), languages


def fit(docs: DataFrame) -> Network:
    x, y, languages = training_rows(docs)
    return Network(languages if len(x) else []).train(x, y) if len(x) else Network([])


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in common.slices(batches, 1):
            found = network.predict([common.text_of(t) for t in batch.column(1).to_pylist()])
            arrays = [batch.column(0), batch.column(2), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (common.crc_mod(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"))
    return frame.mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op8_language_id(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def spoken_documents(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a language, with the columns of docs; `und` and probabilities below min_score go."""
    network = fit(docs)
    at = docs.columns.index("text")

    def work(batches):
        for batch in common.slices(batches, at):
            found = network.predict([common.text_of(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([lang != "und" and chance >= min_score for lang, chance in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
