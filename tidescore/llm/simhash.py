"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they share at least 4
bytes at equal positions. Postings are keyed by three positioned bytes: twenty of the 56 position triples are chosen such
that any four positions hold a whole chosen triple, so a qualifying pair meets in a posting. Within a posting the shared
positional bytes of a pair are tallied; pairs with fewer than 4 are dropped, the rest are verified by their differing bits.

Defined cases: a null or wordless text has the fingerprint zero, linked like any other; rows with equal fingerprints are
one component; a null doc_id is carried along, ignored by the minimum (a component of null ids only has a null id); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.llm import common

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
#: Bytes that a qualifying pair shares at the least.
MIN_SHARED = BYTES - MAX_BITS
#: Members of a posting that one run compares; larger postings are dealt out in pairs of blocks.
POSTING_LIMIT = 4096


def position_triples() -> list[tuple[int, int, int]]:
    """The fewest byte triples such that any four of eight positions include one (Turan's construction for 3, 3, 2)."""
    group = (0, 0, 0, 1, 1, 1, 2, 2)
    wanted = {(0, 0, 0), (1, 1, 1), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
    return [t for t in itertools.combinations(range(BYTES), 3) if tuple(group[i] for i in t) in wanted]


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    words = common.text_of(text).encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE_WORDS:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - SHINGLE_WORDS + 1].tolist()
        pieces = map(joined.__getitem__, map(slice, starts, ends[SHINGLE_WORDS - 1 :].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, itertools.repeat(SEED)), np.uint64, len(starts))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, and columns more of longs): fp holds the unsigned fingerprint's bits as a long."""
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = "".join(f", {c} bigint" for c in more)

    def work(batches):
        for batch in common.slices(batches, 1):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], ["id", "fp", *more])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more).mapInArrow(work, f"id {kind}, fp bigint{kinds}")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: a search that compares a found one with the unfound only."""
    links, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            apart = fps[rest] ^ fps[x]
            hit = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= MIN_SHARED
            hit[hit] = np.bitwise_count(apart[hit]) <= MAX_BITS
            links += [(x, y) for y in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return links


def links(distinct: DataFrame, limit: int = POSTING_LIMIT) -> DataFrame:
    """(a, b): links that join the same fingerprints as all links would, from distinct fingerprints fp.

    With a column first, of any type, an end is the pair (first, fp), so that the ends' order is that of first.
    """
    pairs = "first" in distinct.columns
    if not pairs:
        distinct = distinct.withColumn("first", F.lit(None).cast("boolean"))
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(0xFF)) for i in range(BYTES)]
    entries = [
        F.lit(k << 24).bitwiseOR(F.shiftleft(byte[x], 16)).bitwiseOR(F.shiftleft(byte[y], 8)).bitwiseOR(byte[z]).cast("bigint")
        for k, (x, y, z) in enumerate(position_triples())
    ]
    index = distinct.select("fp", "first", F.explode(F.array(*entries)).alias("entry"))
    keys = ["entry", "lo", "hi"]
    dealt = common.split_postings(index, "entry", "fp", limit)
    runs = dealt.select(*keys, "fp", "first").repartition(*keys).sortWithinPartitions(*keys)

    def compare(table: pa.Table):
        fps, firsts = table.column("fp").to_numpy().view(np.uint64), table.column("first").combine_chunks()
        edges = common.bounds([table.column(k).to_numpy() for k in keys])
        a, b = [], []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if e - s > 1:
                for x, y in forest(fps[s:e]):
                    a.append(s + x)
                    b.append(s + y)
        if a:
            ends = [(firsts.take(pa.array(x)), pa.array(fps[x].view(np.int64))) for x in (a, b)]
            return pa.RecordBatch.from_arrays([c for end in ends for c in end], ["a_first", "a_fp", "b_first", "b_fp"])

    kind = distinct.schema["first"].dataType.simpleString()
    found = runs.mapInArrow(lambda it: common.sorted_runs(it, keys, compare), f"a_first {kind}, a_fp bigint, b_first {kind}, b_fp bigint")
    return found.select(*[(F.struct(F.col(f"{end}_first").alias("first"), F.col(f"{end}_fp").alias("fp")) if pairs else F.col(f"{end}_fp")).alias(end) for end in "ab"])


def with_roots(distinct: DataFrame, limit: int) -> DataFrame:
    """distinct, with root, the least (first, fp) that links reach from fp."""
    found = common.connected_components(links(distinct.select("fp", "first"), limit), "a", "b").select(F.col("node.fp").alias("fp"), "root")
    return distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", F.struct("first", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = POSTING_LIMIT) -> DataFrame:
    """One row per row of docs: its id, fp, and component_id, the smallest id that links reach."""
    common.checkpoint_folder(docs.sparkSession)
    marked = fingerprints(docs, id_col, text_col).checkpoint()
    first = F.min(F.struct(F.isnull("id").alias("none"), "id")).alias("first")
    distinct = marked.groupBy("fp").agg(first, F.count(F.lit(1)).alias("n")).checkpoint()
    named = with_roots(distinct, limit).select("fp", "n", F.col("root.first.id").alias("component_id")).checkpoint()
    return common.join_counted(marked, named, ["fp"], "n").select(F.col("id").alias(id_col), "fp", "component_id")


def op3_simhash(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, limit: int = POSTING_LIMIT) -> DataFrame:
    """One row of each component: that with the smallest id, null ids last; of rows that share it, the one with the smallest hash.

    Columns of docs may have any names; a row is known again by its id and hash alone.
    """
    common.checkpoint_folder(docs.sparkSession)
    names = docs.columns
    plain = [f"c{k}" for k in range(len(names))]
    renamed = docs.toDF(*plain)
    key = plain[names.index("doc_id")]
    hashed = renamed.withColumns(common.row_hashes(renamed))
    marked = fingerprints(hashed, key, plain[names.index("text")], ("_h1", "_h2")).groupBy("fp", "id", "_h1", "_h2").agg(F.count(F.lit(1)).alias("rows")).checkpoint()
    place = F.struct(F.isnull("id").alias("none"), "id", F.col("_h1").alias("h1"), F.col("_h2").alias("h2"), "rows")
    distinct = marked.groupBy("fp").agg(F.min(place).alias("first")).checkpoint()
    kept = with_roots(distinct, limit).where("root.fp = fp").select("first.*").checkpoint()
    same = (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2"))
    # texts are shuffled only where their hash's slot holds a row that goes, or one of several equal rows
    doubtful = marked.join(kept.where("rows = 1").select("h1", "h2"), same, "left_anti")
    slots = F.broadcast(doubtful.select(common.slot("_h1", "_h2").alias("slot")).distinct())
    sure = hashed.join(slots, common.slot("_h1", "_h2") == F.col("slot"), "left_anti")
    joined = hashed.join(slots, common.slot("_h1", "_h2") == F.col("slot"), "left_semi").join(kept, F.col(key).eqNullSafe(F.col("id")) & same)
    once = sure.select(*plain).unionByName(joined.where("rows = 1").select(*plain))
    if not kept.where("rows > 1").isEmpty():
        once = once.unionByName(joined.where("rows > 1").dropDuplicates([key, "_h1", "_h2"]).select(*plain))
    return once.toDF(*names)
