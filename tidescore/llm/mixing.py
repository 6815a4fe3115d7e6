"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums, an exact cut.

A source's target is its weight's share of all words, at most max_epochs times its own words; what exceeds that is shared
out again by weight until no source is above its limit. That fixed point has a closed form: with sources sorted by
limit / weight, target = min(limit, level * weight), where level is the largest of (words left) / (weights left) over the
sorted sources. Its input is one row per source.

Within a source, documents are ordered by a hash-random key. The key's first hex digits deal them into ranges; sums of the
ranges give each range its offset, and a running sum inside the range completes the prefix sum, so that no task sorts a
whole source. A source takes whole passes over its documents, then the rest of its budget in key order, the last document
in part. Budgets are whole words, so a source's taken words equal its rounded target.

Defined cases: null text has size 0; a null source is a source and comes last; documents of size 0 take 0; repeated rows
are taken on their own, in the order of key, id and size; equal rows are interchangeable; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidescore.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
#: Documents of a range, about, if one source had them all; the ranges' number follows from it.
RANGE_ROWS = 10_000


def range_digits(rows: int) -> int:
    """Hex digits of the key that deal a source's documents into ranges; they change no result."""
    return min(8, max(1, math.ceil(math.log(max(1, rows / RANGE_ROWS), 16))))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, budget) from (source, size)."""
    sources = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("bigint")
    limit = (F.lit(max_epochs) * F.col("source_size")).alias("limit")
    weighted = sources.select("source", "source_size", weight.alias("weight"), limit)
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))
    levels = weighted.withColumn("level", left.cast("double") / weights_left)
    target = F.least(F.col("limit").cast("double"), F.max("level").over(everything) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target")).withColumn("budget", F.floor(F.col("target") + 0.5).cast("bigint"))


def size_of(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")


def key_of(id_col: str, size_col: str, seed: str = SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col(size_col).cast("string")).cast("binary"))


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, more: tuple[str, ...] = ()) -> DataFrame:
    """mix's columns, and passes, the whole passes over a row's source, and key."""
    common.checkpoint_folder(docs.sparkSession)
    sized = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), *more)
        .withColumn("key", key_of("doc_id", "size", seed))
        .checkpoint()
    )
    sized = sized.withColumn("part", F.substring("key", 1, range_digits(sized.count())))
    targets = source_targets(sized, weights, max_epochs)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sized.groupBy("source", "part").agg(F.sum("size").alias("n")).select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    plan = (
        ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select(F.col("r.source").alias("s"), F.col("part").alias("p"), "offset", "source_size", "target", "budget")
    )
    inside = Window.partitionBy("source", "part").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["s"]) & (placed["part"] == plan["p"]))
    passes = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - passes * F.col("source_size") - F.col("offset") - F.col("ahead")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), *more, passes.cast("bigint").alias("passes"), "key")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, and columns more, which order rows of one id and size."""
    return _mix(docs, id_col, text_col, source_col, weights, max_epochs, seed, more).drop("passes", "key")


def op4_mix(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def with_source(rows: DataFrame, source: str, table: DataFrame) -> DataFrame:
    """rows joined with a table of one row for each source s: broadcast up to a size, beyond it shuffled."""
    small = table.count() <= common.BROADCAST_SPLITS
    return rows.join(F.broadcast(table) if small else table, F.col(source).eqNullSafe(F.col("s")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a document once for each pass that takes it; the one at its source's cut ends with the last word taken.

    Documents without words stay out: a mix of words takes none of them. Texts aren't shuffled: a source's last pass ends at
    one row in the order of key, id, size and hash, and every row knows its side of that cut. Each row has its own counts,
    whatever its id; of rows equal in all columns at a cut, one stands for all and has their sum.
    """
    names = docs.columns
    plain = [f"c{k}" for k in range(len(names))]
    renamed = docs.toDF(*plain)
    key, text, source = (plain[names.index(c)] for c in ("doc_id", "text", "source"))
    hashed = renamed.withColumns(common.row_hashes(renamed))
    place = lambda doc_id: F.struct("key", F.col(doc_id).alias("doc_id"), "size", "_h1", "_h2")
    rows = _mix(hashed, key, text, source, more=("_h1", "_h2")).withColumn("place", place("doc_id")).checkpoint()
    last = F.max(F.when(F.col("taken") > F.col("passes") * F.col("size"), F.col("place")))
    cuts = rows.groupBy(F.col("source").alias("s")).agg(F.max("passes").alias("whole"), last.alias("cut")).checkpoint()
    sums = with_source(rows, "source", cuts).where("place = cut").groupBy("s").agg(F.sum("taken").alias("at_cut"), F.count(F.lit(1)).alias("rows")).withColumnRenamed("s", "at")
    plan = cuts.join(sums, F.col("s").eqNullSafe(F.col("at")), "left").drop("at").checkpoint()
    sized = hashed.withColumn("size", size_of(text)).withColumn("key", key_of(key, "size")).withColumn("place", place(key))
    is_cut = F.coalesce(F.col("place") == F.col("cut"), F.lit(False))
    times = F.col("whole") + F.coalesce((F.col("place") < F.col("cut")).cast("int"), F.lit(0))
    joined = with_source(sized, source, plan).withColumn("is_cut", is_cut).withColumn("taken", F.when(is_cut, F.col("at_cut")).otherwise(times * F.col("size")))
    if not plan.where("rows > 1").isEmpty():
        joined = joined.where("NOT is_cut OR rows = 1").unionByName(joined.where("is_cut AND rows > 1").dropDuplicates([source]))
    copies = joined.withColumn("copy", F.explode(F.expr("if(taken > 0, sequence(1, cast(ceil(taken / size) as int)), cast(array() as array<int>))")))
    whole = F.col("taken") - (F.col("copy") - 1) * F.col("size") >= F.col("size")
    first = F.expr(rf"array_join(slice(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0), 1, cast(taken - (copy - 1) * size as int)), '')")
    out = copies.withColumn(text, F.when(whole, F.col(text)).otherwise(first))
    if "n_chars" in names:
        chars = plain[names.index("n_chars")]
        out = out.withColumn(chars, F.when(whole, F.col(chars)).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*plain).toDF(*names)


#: DuckDB: the same sums; key order is that of md5's hex digits.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS BIGINT) AS weight
  FROM sources
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER ahead, 0) AS DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0)) AS level
  FROM weighted
  WINDOW ahead AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM levels
), budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS passes FROM targets
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source
    ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sized
)
SELECT p.doc_id, p.size, b.source_size, b.target,
       CAST(b.passes * p.size + greatest(0, least(p.size, b.budget - b.passes * b.source_size - p.ahead)) AS BIGINT) AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
"""
