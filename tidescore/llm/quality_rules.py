"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio between trusted and raw text.

The model is two multinomials over hashed byte n-grams: one of all documents, one of the documents labelled good. A text's
score is the mean over its n-grams of log(p_trusted / p_raw). A text is kept if it passes the base rules and its score
is at least a fixed threshold, for every document alike. Counts cover all documents and all labelled ones.

All documents are counted where they lie; the trusted ones, found by a semi-join with the ids of good labels, are counted
apart. The plan is the same at every size: documents whose id's slot, one of common.SLOTS, holds no trusted id are dropped by a
broadcast of the slots, whose number is bounded, and the others are shuffled to the ids. A partition adds up its own
counts and yields them in chunks of CHUNK buckets, which are summed by chunk. Only the finished model, of BUCKETS weights,
comes to the driver.

Defined cases: null text has no words; texts under ten words fail the base rules; a text without n-grams scores 0; without
any trusted text every score is 0; a document labelled more than once is trusted if any of its labels is 1; null ids match
no label; extra columns are ignored; repeated rows are each judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.llm import common

BUCKETS, CHUNK = 1 << 16, 1 << 12
ORDER = 3
#: Pseudo-count that both multinomials get, split evenly over the buckets.
SMOOTHING = 65_536.0
#: Mean log ratio below which a text is rejected.
THRESHOLD = -0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\r\x0b\x0c"


def n_repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    size = np.uint64(len(seen))
    if len(seen) ** window < 2**63:
        keys = np.zeros(n, np.uint64)
        for i in range(window):
            keys = keys * size + number[i : i + n]
    else:  # two pairs and the rest, numbered one after the other: exact at any number of words
        keys = number[:n]
        for i in range(1, window):
            keys = np.unique(keys * size + number[i : i + n], return_inverse=True)[1].astype(np.uint64)
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(count[place] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat_words(words),
    )


def buckets(text: str, order: int = ORDER, size: int = BUCKETS) -> np.ndarray:
    """The bucket of each byte n-gram, repeats included."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) < order:
        return np.zeros(0, np.int64)
    key = np.zeros(len(raw) - order + 1, np.uint32)
    for i in range(order):
        key = (key << np.uint32(8)) | raw[i : i + len(key)]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - size.bit_length() + 1)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket is met in a column of texts."""

    def pack(chunks: dict[int, np.ndarray]):
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([c.tobytes() for c in chunks.values()], pa.binary())], ["chunk", "counts"])

    def count(batches):
        tally = np.zeros(BUCKETS, np.int64)
        for batch in common.slices(batches, 0):
            for text in filter(None, batch.column(0).to_pylist()):
                tally += np.bincount(buckets(text), minlength=BUCKETS)
        yield from pack({k: c for k, c in enumerate(tally.reshape(-1, CHUNK)) if c.any()})

    def add(batches):
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunks[chunk] = chunks.get(chunk, 0) + np.frombuffer(counts, np.int64)
        yield from pack(chunks)

    kinds = "chunk int, counts binary"
    out = np.zeros(BUCKETS)
    for row in texts.mapInArrow(count, kinds).repartition("chunk").mapInArrow(add, kinds).collect():  # BUCKETS / CHUNK rows
        out[row.chunk * CHUNK :][:CHUNK] = np.frombuffer(row.counts, np.int64)
    return out


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(p_trusted / p_raw) of each bucket, from all documents and all labelled ones."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    slots = trusted.select(common.slot("_id").alias("_slot")).distinct()
    likely = docs.select("doc_id", "text").join(F.broadcast(slots), common.slot("doc_id") == F.col("_slot"), "left_semi")
    raw = bucket_counts(docs.select("text"))
    target = bucket_counts(likely.join(trusted.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi").select("text"))
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + SMOOTHING / BUCKETS * (x.sum() / raw.sum())) / (x.sum() * (1 + SMOOTHING / raw.sum()))
    return np.log(share(target) / share(raw))


def score(text: str, weights: np.ndarray) -> float:
    found = buckets(text)
    return float(weights[found].mean()) if len(found) else 0.0


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score (to nine places)."""
    weights = log_ratios(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in common.slices(batches, 1):
            rows = []
            for text in map(common.text_of, batch.column(1).to_pylist()):
                counts = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                ratio = score(text, weights)
                rows.append((*counts, failed, not failed and ratio >= threshold, round(ratio, 9)))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            arrays = [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    schema = f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def op6_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with the columns of docs: a row is judged where it stands, without a join."""
    weights = log_ratios(docs.select("doc_id", "text"), labels)
    names = docs.columns
    at = names.index("text")

    def work(batches):
        for batch in common.slices(batches, at):
            keep = []
            for text in map(common.text_of, batch.column(at).to_pylist()):
                counts = base_counts(text)
                keep.append(counts[0] >= MIN_WORDS and 100 * counts[4] <= MAX_REPEAT_PERCENT * counts[0] and score(text, weights) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


#: DuckDB: byte trigrams by their hex digits, hashed into the same buckets.
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, hex(encode(coalesce(text, ''))) AS h FROM documents
), grams AS (
  SELECT r, (CAST('0x' || substr(h, 2 * i + 1, 6) AS BIGINT) * 2654435761 % 4294967296) >> {32 - BUCKETS.bit_length() + 1} AS bucket, count(*) AS n
  FROM (SELECT r, h, unnest(range(len(h) // 2 - {ORDER - 1})) AS i FROM docs) GROUP BY ALL
), trusted AS (SELECT r FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), counts AS (SELECT bucket, sum(n) AS raw, coalesce(sum(n) FILTER (r IN (FROM trusted)), 0) AS target FROM grams GROUP BY bucket
), sums AS (SELECT CAST(sum(raw) AS DOUBLE) AS raw_all, CAST(sum(target) AS DOUBLE) AS target_all FROM counts
), weights AS (
  SELECT bucket, CASE WHEN target_all > 0 THEN ln(((target + {SMOOTHING / BUCKETS} * (target_all / raw_all)) / target_all) / ((raw + {SMOOTHING / BUCKETS}) / raw_all)) ELSE 0 END AS weight FROM counts, sums
), scores AS (SELECT r, sum(n * weight) / sum(n) AS score FROM grams JOIN weights USING (bucket) GROUP BY r
), windows AS (SELECT r, i, w[i : i + {WINDOW - 1}] AS five FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM docs)
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS met FROM windows), range({WINDOW}) AS x(k) WHERE met > 1 GROUP BY r
), judged AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(score, 0.0::DOUBLE) AS score FROM docs LEFT JOIN repeated USING (r) LEFT JOIN scores USING (r)
), failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {THRESHOLD} AS kept, round(score, 9) AS score FROM failed
"""
