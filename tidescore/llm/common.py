"""Helpers that several operators share: checkpoints, sorted runs of a key, hot keys, connected components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes up at once, but for one longer text.
TEXT_BYTES = 3_000_000
#: Hash slots, the most rows that a broadcast of slots holds.
SLOTS = 1 << 20
#: Rows of an Arrow batch that the entry points ask for.
ENTRY_ROWS = 1000
#: A key's share of all rows, as a fraction 1 / HOT, beyond which its rows don't go through a shuffle; no more than HOT keys can have it.
HOT = 4096
#: Rows of a table of split postings up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_SPLITS = 100_000


def entry_session(spark: SparkSession) -> SparkSession:
    """For entry points, not operators: a session that leaves the rows of an Arrow batch at Spark's default gets ENTRY_ROWS, for executors of little memory.

    Operators take texts up in slices bounded by bytes whatever the batches are, and their results don't depend on it.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ENTRY_ROWS))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it names none, a local session gets a temporary one; a cluster must name one that its machines share."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if held.isEmpty():
            context.setCheckpointDir(named)
        return named
    if held.isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts in a column reach a number of bytes, so that memory doesn't grow with rows or texts.

    After the last one what the task has freed is given back.
    """
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)) + 64, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e > s:
                yield batch.slice(s, e - s)
    give_back()


def give_back() -> None:
    """Returns what a finished task has freed to the system; a Python worker waits for its next task as a small process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def crc_mod(column, modulus: int):
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slot(*columns: str):
    """One of SLOTS numbers, by a hash. A table of distinct slots has a bounded size, so it may be broadcast."""
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns]), F.lit(SLOTS))


def row_hashes(docs: DataFrame) -> dict:
    """_h1, _h2: 128 bits of hash of a row's columns (maps aside), which tell rows apart whatever their ids."""
    names = [c for c, kind in docs.dtypes if "map<" not in kind]
    parts = [F.col(f"`{c}`") for c in names] + [F.isnull(f"`{c}`") for c in names]  # xxhash64 skips nulls
    return {f"_h{k}": F.xxhash64(F.lit(k), *parts) for k in (1, 2)}


def bounds(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal rows in columns that are sorted together, and the end."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], every: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Calls work with whole runs of equal keys: the rows of one partition come sorted by keys, and a run may span batches.

    Only the rows of the last, unfinished run and fewer than `every` others are held.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < every:
            continue
        table = pa.Table.from_batches(held)
        last = {k: table.column(k)[rows - 1].as_py() for k in keys}
        tail = np.ones(rows, bool)
        for k in keys:
            tail &= table.column(k).to_numpy() == last[k]
        cut = rows - int(tail.sum())
        if cut:
            if (out := work(table.slice(0, cut))) is not None:
                yield out
        rest = table.slice(cut).combine_chunks()
        held, rows = rest.to_batches(), rest.num_rows
        every = max(every, 2 * rows) if rows * 2 > every else every
    if rows and (out := work(pa.Table.from_batches(held))) is not None:
        yield out


def split_postings(index: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Deals postings of over about `limit` members out as pairs of blocks; every pair of members still meets, once.

    Adds lo, hi (the pair of blocks that a run compares) and own (this row's block). A posting is the one run 0, 0, unless
    it is large: then it is split into blocks by a hash of the member, and a row goes to one run for each other block, so
    that no run holds much more than two blocks. Large postings are found by counting the members that a hash draws, one
    in limit / 32; a wrong guess makes runs smaller or somewhat larger, and changes no result.
    """
    rate = max(1, limit // 32)
    drawn = index.where(F.pmod(F.xxhash64(F.col(member), F.lit("draw")), F.lit(rate)) == 0)
    counts = drawn.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * rate > limit)
    large = counts.select(key, F.ceil(F.col("_n") * rate / limit).cast("int").alias("_b")).checkpoint()
    met = large.count()
    if not met:
        return index.withColumns({"own": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    joined = index.join(F.broadcast(large) if met <= BROADCAST_SPLITS else large, key, "left").withColumn("_b", F.coalesce("_b", F.lit(1)))
    own = F.pmod(F.xxhash64(F.col(member), F.lit("block")), F.col("_b")).cast("int")
    dealt = joined.withColumn("own", own).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return dealt.withColumn("lo", F.least("own", "_x")).withColumn("hi", F.greatest("own", "_x")).drop("_b", "_x")


def join_counted(rows: DataFrame, named: DataFrame, key: list[str], count: str, total: int | None = None) -> DataFrame:
    """rows joined by key with named, which has one row a key and counts the key's rows.

    Keys with over 1 / HOT of all rows, at most HOT of them, are broadcast; the others' rows are shuffled. No task holds one hot key's rows.
    """
    if total is None:
        total = named.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    many = rows.join(F.broadcast(named.where(hot)), key)
    few = rows.join(F.broadcast(named.where(hot).select(*key)), key, "left_anti").join(named.where(~hot), key)
    return many.unionByName(few)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): each node that has an edge, and the smallest node it reaches. Edges with a null end are ignored.

    Alternating star contraction: every round links each node's larger neighbours to its smallest one, then each node's
    smaller neighbours to its smallest one. Each round is two map-side-combined minimums and joins, checkpointed; no adjacency
    list is gathered, and a node with many neighbours is no hot key. The rounds end when the set of edges no longer changes.
    Nodes are of any type that has an order.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    current = edges.where(F.col(a) != F.col(b)).select(u, v).distinct().checkpoint()
    least, rows = F.min("v").alias("m"), F.count(F.lit(1)).alias("n")
    state = None
    for _ in range(max_rounds):
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v")).distinct()
        state = now
        below = current.groupBy("u").agg(least).select(F.col("u").alias("v"), "m")
        ends = current.groupBy("v").agg(rows).join(below, "v", "left").select("v", "n", F.coalesce("m", "v").alias("m"))
        large = join_counted(current, ends, ["v"], "n", now[0]).select("u", F.col("m").alias("v")).distinct().checkpoint()
        starts = large.groupBy("u").agg(least, rows)
        hook = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        current = join_counted(large, starts, ["u"], "n", large.count()).select(hook.alias("u"), F.col("m").alias("v")).distinct().checkpoint()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def text_of(value) -> str:
    return "" if value is None else value
