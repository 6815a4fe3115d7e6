"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosine checks.

Equal vectors, told apart by 128 bits of hash, are one node with a count. A table hashes a normalised vector by K quantised
projections floor((a . x + b) / WIDTH) with normal a and uniform b. K grows with the logarithm of the number of nodes, so
that an unrelated pair shares a bucket of a table with a chance of about BUCKET / nodes; the number of tables is the fewest
that find a pair right at the threshold with a chance of at least RECALL (closer pairs are found more surely).

Postings carry no vectors: a node's number and a code of CODE_BITS signs of projections. Within a bucket, nodes whose codes
differ in more bits than a pair at the threshold ever does (FAR_DEVIATIONS) don't meet; the nodes that meet another one go
on to a second run of the bucket with their vectors, where cosines are taken in double precision.

Links are counted where they are found and never listed: a pair counts in the first table in which it shares a bucket,
which the vectors' hashes tell. Of a bucket's links only a spanning forest leaves the task. Buckets of over BUCKET_LIMIT
nodes are compared in pairs of blocks, in separate runs.

Defined cases: a vector that is null, empty, zero, or holds a null or a non-finite component links with nothing and is its
own component; vectors of different lengths never link; rows that repeat a vector link with each other, also when they
repeat an id; a null id is ignored by the minimum unless all ids of a component are null; extra columns are ignored.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.llm import common

THRESHOLD = 0.9
RECALL = 0.95
WIDTH = 2.0
#: Unrelated vectors that share a bucket with a vector, about.
BUCKET = 512
#: Tables at the least: few vectors need few, but a miss would weigh more.
LEAST_TABLES = 12
#: Bits of the code that postings carry, and how far beyond the mean a pair at the threshold may differ in them.
CODE_BITS, FAR_DEVIATIONS = 128, 3.5
#: Nodes that one run compares; larger buckets are dealt out in pairs of blocks.
BUCKET_LIMIT = 2048
SEED = 10


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised normal projection of two vectors at a distance agrees."""
    if distance == 0:
        return 1.0
    r = width / distance
    return 1 - 2 * NormalDist().cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(nodes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables)."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(2.0, nodes / BUCKET)) / -math.log(far)))
    return k, max(LEAST_TABLES, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def code_distance(threshold: float = THRESHOLD) -> int:
    """The number of differing code bits beyond which two nodes don't meet."""
    chance = math.acos(threshold) / math.pi
    return math.floor(CODE_BITS * chance + FAR_DEVIATIONS * math.sqrt(CODE_BITS * chance * (1 - chance)))


class Hasher:
    """Bucket keys (n, tables) and codes (n, 2) of normalised vectors of one length."""

    def __init__(self, dimension: int, k: int, tables: int):
        rng = np.random.default_rng(SEED + dimension)
        self.k, self.tables = k, tables
        self.directions = rng.normal(0, 1, (dimension, tables * k))
        self.offsets = rng.uniform(0, WIDTH, tables * k)
        self.mix = rng.integers(1, 2**62, (tables, k), dtype=np.int64) * 2 + 1
        self.signs = rng.normal(0, 1, (dimension, CODE_BITS))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        cells = np.floor((x @ self.directions + self.offsets) / WIDTH).astype(np.int64).reshape(len(x), self.tables, self.k)
        mixed = (cells * self.mix).sum(axis=2)  # wraps around; the high bits are the best mixed, so the table's number replaces low ones
        return (mixed >> 12) << 12 | np.arange(self.tables)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.signs >= 0, axis=1).view(np.int64)


def usable(column):
    """Whether a vector can link at all."""
    size = F.size(column)
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(column.isNotNull() & (size > 0) & finite & F.exists(column, lambda v: v != 0), F.lit(False))


def _matrix(column, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows by their lengths; scaled first, so that very large and very small components don't overflow or vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sides(own: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a run's two blocks."""
    left = np.flatnonzero(own == lo)
    return left, left if lo == hi else np.flatnonzero(own == hi)


def meeting(code: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Which rows of a run have a row of the other block (of the same one, if it is but one) whose code is near."""
    met = np.zeros(len(code), bool)
    for s in range(0, len(left), 512):
        a = left[s : s + 512]
        far = np.bitwise_count(code[a, None, 0] ^ code[None, right, 0])
        near = far + np.bitwise_count(code[a, None, 1] ^ code[None, right, 1]) <= most
        if left is right:
            near[np.arange(len(a)), np.arange(s, s + len(a))] = False
        met[a] |= near.any(axis=1)
        met[right] |= near.any(axis=0)
    return met


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each the least row of its group, after joining the groups of every i and j."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def compare_block(x: np.ndarray, count: np.ndarray, keys: np.ndarray, own: np.ndarray, table: int, lo: int, hi: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, label of each row's group) among the unit rows of a run; links of a pair that shares a bucket of an earlier table are left out."""
    left, right = sides(own, lo, hi)
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    if table and (keys[:, :table] == keys[0, :table]).all(axis=0).any():
        return links, label  # all of them share a bucket of an earlier table
    for s in range(0, len(left), 1024):
        a = left[s : s + 1024]
        i, j = np.nonzero(x[a] @ x[right].T >= threshold)
        i, j = a[i], right[j]
        fresh = i < j if lo == hi else i != j
        i, j = i[fresh], j[fresh]
        if table and len(i):
            new = np.concatenate([~(keys[i[k : k + 65536], :table] == keys[j[k : k + 65536], :table]).any(axis=1) for k in range(0, len(i), 65536)])
            i, j = i[new], j[new]
        np.add.at(links, i, count[j])
        np.add.at(links, j, count[i])
        label = merge(label, i, j)
    return links, label


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per row of vectors: its id, n_links, component_id, kept."""
    common.checkpoint_folder(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    hashes = {f"h{k}": F.xxhash64(F.lit(k), "v") for k in (1, 2)}
    good = rows.where(usable(F.col("v"))).withColumns(hashes)
    one = good.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nodes = one.withColumn("node", F.monotonically_increasing_id()).checkpoint()  # numbered where they lie, then fixed
    k, tables = parameters(nodes.count(), threshold, recall)
    most = code_distance(threshold)

    def hashed(batches):
        made: dict[int, Hasher] = {}
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                x = unit(_matrix(part.column(1), d))
                own = made.setdefault(d, Hasher(d, k, tables))
                code = np.repeat(own.codes(x), tables, axis=0)
                arrays = [own(x).ravel(), np.repeat(part.column(0).to_numpy(), tables), code[:, 0], code[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in arrays], ["key", "node", "c1", "c2"])

    index = nodes.select("node", "v").mapInArrow(hashed, "key bigint, node bigint, c1 bigint, c2 bigint")
    keys = ["key", "lo", "hi"]
    runs = common.split_postings(index, "key", "node", limit).repartition(*keys).sortWithinPartitions(*keys)

    def meet(table: pa.Table):
        columns = [table.column(c).to_numpy() for c in (*keys, "own", "node")]
        code = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("c1", "c2")], axis=1)
        edges = common.bounds(columns[:3])
        met = np.zeros(len(code), bool)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if e - s > 1:
                met[s:e] = meeting(code[s:e], *sides(columns[3][s:e], int(columns[1][s]), int(columns[2][s])), most)
        if met.any():
            return pa.RecordBatch.from_arrays([pa.array(c[met]) for c in columns], [*keys, "own", "node"])

    met = runs.mapInArrow(lambda it: common.sorted_runs(it, keys, meet), "key bigint, lo int, hi int, own int, node bigint")
    again = met.join(nodes.select("node", "n", "v"), "node").repartition(*keys).sortWithinPartitions(*keys)

    def compare(table: pa.Table):
        table = table.combine_chunks()
        columns = [table.column(c).to_numpy() for c in keys]
        edges = common.bounds(columns)
        node, count, own = (table.column(c).to_numpy() for c in ("node", "n", "own"))
        vectors_ = table.column("v").combine_chunks()
        sizes = vectors_.value_lengths().to_numpy()
        made: dict[int, Hasher] = {}
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            key, lo, hi = (int(c[s]) for c in columns)
            for d in np.unique(sizes[s:e]).tolist():
                at = s + np.flatnonzero(sizes[s:e] == d)
                x = unit(_matrix(vectors_.take(pa.array(at)), d))
                links, label = compare_block(x, count[at], made.setdefault(d, Hasher(d, k, tables))(x), own[at], key & 0xFFF, lo, hi, threshold)
                linked, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(at)))
                out.append((node[at][linked], np.full(len(linked), -1), links[linked]))
                out.append((node[at][joined], node[at][label[joined]], np.zeros(len(joined), np.int64)))
        if out:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "links"])

    found = again.mapInArrow(lambda it: common.sorted_runs(it, keys, compare, 2 * limit), "a bigint, b bigint, links bigint").checkpoint()
    linked = found.where("b < 0").groupBy("a").agg(F.sum("links").alias("links"))
    place = nodes.select("node", "h1", "h2", F.struct(F.isnull("first").alias("none"), "first", "node").alias("place"), "n")
    ends = found.where("b >= 0").select("a", "b").join(place.select(F.col("node").alias("a"), F.col("place").alias("p")), "a").join(place.select(F.col("node").alias("b"), F.col("place").alias("q")), "b")
    parts = common.connected_components(ends, "p", "q").select(F.col("node.node").alias("node"), F.col("root.first").alias("component_id"), F.lit(True).alias("found"))
    named = place.join(parts, "node", "left").join(linked, F.col("node") == F.col("a"), "left").select(
        "h1", "h2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("place.first")).alias("component_id")
    )
    linking = common.join_counted(good.drop("v"), named.checkpoint(), ["h1", "h2"], "n").select("id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("v"))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linking.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_embedding_dedup(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


#: DuckDB: the cosine of every pair.
SQL = f"""
WITH RECURSIVE vectors AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), good AS (
  SELECT r, v, sqrt(list_dot_product(v, v)) AS size FROM vectors
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r WHERE CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) / (a.size * b.size) >= {THRESHOLD} ELSE false END
), reach AS (SELECT r AS a, r AS b FROM vectors UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), parts AS (SELECT reach.a AS r, min(vectors.vec_id) AS component_id FROM reach JOIN vectors ON vectors.r = reach.b GROUP BY reach.a
), counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM vectors JOIN parts USING (r) LEFT JOIN counts USING (r)
"""
