"""One query per operator over the driver's tables, and DuckDB SQL for each.

The tables hold no pictures, logits or latencies, so embeddings stand for logits and 8x8 tiles, events for requests.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescore.functions import pixels, scalars
from tidescore.operators import replay, scoring, stats, validation
from tidescore.plans import predict
from tidescore.sources import inputs, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLASS_COUNT, WIDTH = 64, 10
#: A class without a label, for the outer join.
HOLE = 7


def class_labels(spark: SparkSession) -> DataFrame:
    return spark.range(CLASS_COUNT).where(F.col("id") != HOLE).select(F.col("id").cast("int").alias("class_index"), F.concat(F.lit("class "), F.col("id").cast("string")).alias("class_name"))


LABELS = f"labels_ AS (SELECT CAST(range AS INT) AS class_index, 'class ' || range AS class_name FROM range({CLASS_COUNT}) WHERE range <> {HOLE})"
TOP1 = """top AS (
  SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS class_index,
         round(1 / list_sum(list_transform(embedding, lambda x: exp(CAST(x - list_max(embedding) AS DOUBLE)))), 6) AS confidence
  FROM embeddings)"""


@query(f"WITH {LABELS}, {TOP1} SELECT vec_id, class_index, class_name, confidence FROM top LEFT JOIN labels_ USING (class_index)")
def softmax_top1(spark, d):
    rows = predict.top1(table(spark, d, "embeddings"), "embedding")
    return scoring.route(rows, class_labels(spark)).select("vec_id", "class_index", "class_name", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {LABELS}, {TOP1} SELECT class_index, class_name, count(*) AS n FROM top LEFT JOIN labels_ USING (class_index) GROUP BY ALL")
def class_label_left_join(spark, d):
    return scoring.route(predict.top1(table(spark, d, "embeddings"), "embedding"), class_labels(spark)).groupBy("class_index", "class_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, CAST(arg_min(i, (-x, i)) AS INT) AS class_index FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY vec_id")
def argmax_relational(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("vec_id").agg(F.max_by("i", F.struct(F.col("x"), -F.col("i"))).cast("int").alias("class_index"))


@query("""
SELECT vec_id // 8 AS batch_id, CAST(row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS INT) AS pos,
       CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS class_index FROM embeddings""")
def split_batch_logits(spark, d):
    """Rows of eight packed into one row-major array and split again."""
    packed = table(spark, d, "embeddings").groupBy((F.floor(F.col("vec_id") / 8)).alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
    flat = packed.select("batch_id", F.size("rows").alias("n"), F.flatten(F.transform("rows", lambda r: r["embedding"])).alias("logits"))
    split = flat.select("batch_id", F.posexplode(scalars.split_rows(F.col("logits"), F.col("n"), CLASS_COUNT)).alias("pos", "row"))
    return split.select("batch_id", "pos", scalars.argmax_first(F.col("row")).alias("class_index"))


def head_weights() -> np.ndarray:
    """weight[i, c] = ((3 i + 5 c) mod 11 - 5) / 8, exact in binary."""
    i, c = np.meshgrid(np.arange(CLASS_COUNT), np.arange(WIDTH), indexing="ij")
    return ((3 * i + 5 * c) % 11 - 5) / 8


@query(f"""
WITH scores AS (
  SELECT vec_id, c, list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(range({CLASS_COUNT}), lambda i: ((3 * i + 5 * c) % 11 - 5) / 8.0::DOUBLE)) AS s
  FROM embeddings, (SELECT range AS c FROM range({WIDTH})))
SELECT vec_id, CAST(arg_max(c, s) AS INT) AS class_index, round(max(s), 6) AS score FROM scores GROUP BY vec_id""")
def linear_head_score(spark, d):
    """A model run in Arrow batches of 32."""
    model = scoring.LinearModel(head_weights())
    scored = scoring.score(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", model, CLASS_COUNT, WIDTH, "float64")
    return scored.select("vec_id", scalars.argmax_first(F.col("logits")).alias("class_index"), F.round(F.array_max("logits"), 6).alias("score"))


@query("SELECT vec_id, CASE WHEN len(v) <> 64 THEN 'input length ' || len(v) || ', want 64' END AS error FROM (SELECT vec_id, embedding[1:CAST(60 + vec_id % 5 AS INT)] AS v FROM embeddings)")
def input_guard(spark, d):
    cut = F.slice("embedding", F.lit(1), (F.lit(60) + F.col("vec_id") % 5).cast("int"))
    rows = table(spark, d, "embeddings").select("vec_id", cut.alias("v"))
    return scoring.score(rows, "v", scoring.LinearModel(head_weights().astype(np.float32)), CLASS_COUNT, WIDTH).select("vec_id", "error")


# Pixels: an embedding as an 8x8 grey tile.
TILE, BIG, CROP = 8, 16, 14
TILE_SQL = f"tiles AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(least(greatest(floor((e + 0.5) * 256), 0), 255) AS DOUBLE)) AS p FROM embeddings)"
GRID_SQL = f"""
grid AS (SELECT range AS o, greatest(least(CAST(floor((range + 0.5) * 0.5 - 0.5) AS INT), {TILE - 1}), 0) AS a,
                least(CAST(floor((range + 0.5) * 0.5 - 0.5) AS INT) + 1, {TILE - 1}) AS b, (range + 0.5) * 0.5 - 0.5 - floor((range + 0.5) * 0.5 - 0.5) AS f FROM range({BIG})),
raw AS (SELECT vec_id, y.o AS y, x.o AS x, p[y.a * 8 + x.a + 1] + (p[y.a * 8 + x.b + 1] - p[y.a * 8 + x.a + 1]) * x.f AS top,
               p[y.b * 8 + x.a + 1] + (p[y.b * 8 + x.b + 1] - p[y.b * 8 + x.a + 1]) * x.f AS low, y.f AS fy FROM tiles, grid y, grid x),
blend AS (SELECT vec_id, y, x, top + (low - top) * fy AS v FROM raw)"""
CROP_SQL = f"y BETWEEN 1 AND {CROP} AND x BETWEEN 1 AND {CROP}"


def tile_rows(spark, d) -> DataFrame:
    """Bytes of the components, by arithmetic of the column's own type as in SQL: a float just below a step is rounded up to it."""
    number = lambda x: F.lit(x).cast("float")
    e = lambda v: F.floor(F.least(F.greatest((v + number(0.5)) * number(256), number(0)), number(255))).cast("int")
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", e).alias("tile"))


def listed(picture: np.ndarray) -> list[int | None]:
    """Its bytes, null for those that depend on pixels the vector lacks."""
    values = picture.ravel().tolist()
    return values if picture.dtype == np.uint8 else [None if math.isnan(v) else int(v) for v in values]


def tile_values(spark, d, mode, raw_bytes=False) -> DataFrame:
    rows = scoring.tiles(tile_rows(spark, d), "vec_id", "tile", TILE, mode, BIG, CROP, scalars.MEAN[:1], scalars.STD[:1], raw_bytes)
    side = BIG if raw_bytes else CROP
    return rows.select(F.col("id").alias("vec_id"), F.posexplode("values").alias("i", "v")).select("vec_id", F.floor(F.col("i") / side).cast("int").alias("y"), (F.col("i") % side).cast("int").alias("x"), "v")


@query(f"WITH {TILE_SQL}, {GRID_SQL} SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(floor(v + 0.5) AS INT) AS v FROM blend")
def tile_resize_bilinear(spark, d):
    return tile_values(spark, d, "rounded", True).withColumn("v", F.col("v").cast("int"))


@query(f"WITH {TILE_SQL}, {GRID_SQL} SELECT vec_id, CAST(y - 1 AS INT) AS y, CAST(x - 1 AS INT) AS x, round((floor(v + 0.5) / 255 - 0.485) / 0.229, 4) AS v FROM blend WHERE {CROP_SQL}")
def tile_normalize_chw(spark, d):
    return tile_values(spark, d, "rounded").withColumn("v", F.round("v", 4))


@query(f"WITH {TILE_SQL}, {GRID_SQL} SELECT vec_id, round(avg((v / 255 - 0.485) / 0.229), 4) AS mean, round(min((v / 255 - 0.485) / 0.229), 4) AS low, round(max((v / 255 - 0.485) / 0.229), 4) AS high FROM blend WHERE {CROP_SQL} GROUP BY vec_id")
def tile_fused(spark, d):
    return tile_values(spark, d, "fused").groupBy("vec_id").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.min("v"), 4).alias("low"), F.round(F.max("v"), 4).alias("high"))


#: Half-pixel grid of a 4x4 tile of three channels resized to 8x8, 6x6 of it cropped.
RGB_SQL = """
rgb AS (SELECT vec_id, list_transform(embedding[1:48], lambda e: CAST(least(greatest(floor((e + 0.5) * 256), 0), 255) AS DOUBLE)) AS p FROM embeddings),
places AS (SELECT range AS o, greatest(least(CAST(floor((range + 0.5) * 0.5 - 0.5) AS INT), 3), 0) AS a, least(CAST(floor((range + 0.5) * 0.5 - 0.5) AS INT) + 1, 3) AS b,
                  (range + 0.5) * 0.5 - 0.5 - floor((range + 0.5) * 0.5 - 0.5) AS f FROM range(1, 7)),
channels(c, mean, std) AS (VALUES (0, 0.485, 0.229), (1, 0.456, 0.224), (2, 0.406, 0.225)),
edges AS (SELECT vec_id, c, mean, std, y.o AS y, x.o AS x, y.f AS fy, p[(y.a * 4 + x.a) * 3 + c + 1] + (p[(y.a * 4 + x.b) * 3 + c + 1] - p[(y.a * 4 + x.a) * 3 + c + 1]) * x.f AS top,
                 p[(y.b * 4 + x.a) * 3 + c + 1] + (p[(y.b * 4 + x.b) * 3 + c + 1] - p[(y.b * 4 + x.a) * 3 + c + 1]) * x.f AS low FROM rgb, places y, places x, channels)"""


@query(f"""WITH {RGB_SQL} SELECT vec_id, CAST(c AS INT) AS channel, CAST(y - 1 AS INT) AS y, CAST(x - 1 AS INT) AS x,
  round((floor(top + (low - top) * fy + 0.5) / 255 - CAST(mean AS DOUBLE)) / CAST(std AS DOUBLE), 4) AS v FROM edges""")
def tile_rgb_chw(spark, d):
    """Interleaved pixels of three channels to normalised planes."""
    rows = tile_rows(spark, d).select("vec_id", F.slice("tile", 1, 48).alias("tile"))
    made = scoring.tiles(rows, "vec_id", "tile", 4, "rounded", 8, 6, scalars.MEAN, scalars.STD)
    v, i = made.select(F.col("id").alias("vec_id"), F.posexplode("values").alias("i", "v")), F.col("i")
    place = lambda of: F.floor(of).cast("int")
    return v.select("vec_id", place(i / 36).alias("channel"), place(i % 36 / 6).alias("y"), (i % 6).cast("int").alias("x"), F.round("v", 4).alias("v"))


@query(f"""WITH {TILE_SQL}, {GRID_SQL}, off AS (SELECT vec_id, abs(floor(v + 0.5) - p[(y // 2) * 8 + x // 2 + 1]) AS a FROM blend JOIN tiles USING (vec_id))
SELECT vec_id, round(avg(a), 6) AS mean_abs, CAST(max(a) AS INT) AS max_abs, round(avg(CASE WHEN a <= 8 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS within_pct FROM off GROUP BY vec_id""")
def pixel_parity(spark, d):
    """Bilinear against nearest pixels, within 8."""
    whole = F.transform(F.sequence(F.lit(1), F.lit(TILE * TILE)), lambda k: F.try_element_at("tile", k))
    near = tile_rows(spark, d).select("vec_id", F.posexplode(whole).alias("i", "n"))
    big = tile_values(spark, d, "rounded", True).withColumn("i", (F.floor(F.col("y") / 2) * TILE + F.floor(F.col("x") / 2)).cast("int"))
    rows = big.join(near, ["vec_id", "i"]).select("vec_id", (F.col("v") - F.col("n")).alias("delta"))
    out = stats.parity(rows, ["vec_id"], "delta", 8)
    return out.select("vec_id", F.round("mean_abs", 6).alias("mean_abs"), F.col("max_abs").cast("int").alias("max_abs"), F.round("within_pct", 6).alias("within_pct"))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda e: least(greatest(floor((e + 0.5) * 256), 0), 255))) AS BIGINT) AS total, 'png' AS format FROM embeddings")
def png_round_trip(spark, d):
    """Tiles written as PNG files' bytes, sniffed and decoded again; a vector of another length is a picture of one line."""

    def work(batches):
        for batch in batches:
            tiles = [t or [] for t in batch.column(1).to_pylist()]
            made = [pixels.encode_png(np.array(t, np.uint8).reshape(TILE if len(t) == TILE * TILE else 1, -1, 1)) for t in tiles]
            sums = [int(pixels.decode_png(b).sum()) if t else None for t, b in zip(tiles, made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array(list(map(pixels.image_format, made)))], ["vec_id", "total", "format"])

    return tile_rows(spark, d).mapInArrow(work, "vec_id bigint, total bigint, format string")


@query(f"""WITH {TILE_SQL}, halves AS (SELECT vec_id, i // 4 AS y, i % 4 AS x, p[16 * (i // 4) + 2 * (i % 4) + 1] + p[16 * (i // 4) + 2 * (i % 4) + 2] + p[16 * (i // 4) + 2 * (i % 4) + 9] + p[16 * (i // 4) + 2 * (i % 4) + 10] AS total
  FROM tiles, range(16) AS r(i))
SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(floor(total / 4 + 0.5) AS INT) AS v FROM halves""")
def tile_scaled_decode(spark, d):
    """Tiles written as PNG files' bytes and decoded at half their size."""

    def half(tile):
        picture = pixels.tile(tile, TILE, TILE, 1)
        if picture.dtype == np.uint8:
            return pixels.shrink(pixels.decode_png(pixels.encode_png(picture)), 1, 2)
        read = pixels.decode_png(pixels.encode_png(np.nan_to_num(picture).astype(np.uint8)))
        return pixels.shrink(np.where(np.isnan(picture), np.nan, read), 1, 2)  # a file can't say which pixels aren't there

    def work(batches):
        for batch in batches:
            made = [listed(half(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], ["vec_id", "half"])

    rows = tile_rows(spark, d).mapInArrow(work, "vec_id bigint, half array<int>").select("vec_id", F.posexplode("half").alias("i", "v"))
    return rows.select("vec_id", F.floor(F.col("i") / 4).cast("int").alias("y"), (F.col("i") % 4).cast("int").alias("x"), "v")


@query(f"""WITH {TILE_SQL}, shades AS (SELECT vec_id, i, c, CAST(p[4 * i + c + 1] AS BIGINT) AS v, CAST(p[4 * i + 4] AS BIGINT) AS alpha FROM tiles, range(16) AS r(i), range(3) AS s(c))
SELECT vec_id, CAST(i AS INT) AS pixel, CAST(c AS INT) AS channel, CAST((v * 257 * (alpha * 257) // 65535) >> 8 AS INT) AS v FROM shades""")
def tile_alpha(spark, d):
    """Tiles of 4x4 straight RGBA pixels, each colour times its alpha."""

    def work(batches):
        for batch in batches:
            made = [listed(pixels.to_rgb(pixels.tile(t, 4, 4, 4))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], ["vec_id", "rgb"])

    rows = tile_rows(spark, d).mapInArrow(work, "vec_id bigint, rgb array<int>").select("vec_id", F.posexplode("rgb").alias("i", "v"))
    return rows.select("vec_id", F.floor(F.col("i") / 3).cast("int").alias("pixel"), (F.col("i") % 3).cast("int").alias("channel"), "v")


# Sizes, from parts.
SIZES = "(SELECT p_partkey, CAST(p_size * 31 + p_partkey % 97 AS INT) AS w, CAST(p_size * 17 + p_partkey % 301 + 1 AS INT) AS h FROM part)"


def sizes(spark, d) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 31 + key % 97).cast("int").alias("w"), (F.col("p_size") * 17 + key % 301 + 1).cast("int").alias("h"))


@query(f"""SELECT p_partkey, CASE {' '.join(f"WHEN (least(w, h) * {n} + {d - 1}) // {d} >= 256 THEN '{n}/{d}'" for n, d in scalars.SCALES)} ELSE '1/1' END AS scale FROM {SIZES}""")
def choose_scale(spark, d):
    s = scalars.choose_scale(F.col("w"), F.col("h"))
    return sizes(spark, d).select("p_partkey", F.concat_ws("/", s["num"].cast("string"), s["den"].cast("string")).alias("scale"))


@query(f"""SELECT p_partkey, rw, rh, CAST((rw - 224) // 2 AS INT) AS left_, CAST((rh - 224) // 2 AS INT) AS top_ FROM (
  SELECT p_partkey, CAST(CASE WHEN w < h THEN 256 ELSE floor(256.0::DOUBLE * w / h + 0.5) END AS INT) AS rw, CAST(CASE WHEN w < h THEN floor(256.0::DOUBLE * h / w + 0.5) ELSE 256 END AS INT) AS rh FROM {SIZES})""")
def resize_dims(spark, d):
    dims = scalars.resized_dims(F.col("w"), F.col("h"))
    rows = sizes(spark, d).select("p_partkey", dims["w"].alias("rw"), dims["h"].alias("rh"))
    return rows.select("*", scalars.crop_offset(F.col("rw")).alias("left_"), scalars.crop_offset(F.col("rh")).alias("top_"))


@query(f"SELECT p_partkey, CAST((w + (1 << (p_partkey % 4)) - 1) // (1 << (p_partkey % 4)) AS INT) AS halved, CAST((h * 3 + 7) // 8 AS INT) AS scaled FROM {SIZES}")
def scaled_dims(spark, d):
    return sizes(spark, d).select("p_partkey", scalars.halved_dim(F.col("w"), (F.col("p_partkey") % 4).cast("int")).alias("halved"), scalars.scaled_dim(F.col("h"), 3, 8).alias("scaled"))


@query("""SELECT p_partkey, greatest(-1.5, least(v, 2.5)) AS clamped, 2.0::DOUBLE + (v - 2.0) * 0.25 AS lerped, CAST(floor(v) AS INT) AS floored
FROM (SELECT p_partkey, CAST(p_partkey % 13 AS DOUBLE) / 2 - 3 AS v FROM part)""")
def scalar_arithmetic(spark, d):
    v = (F.col("p_partkey") % 13).cast("double") / 2 - 3
    return table(spark, d, "part").select("p_partkey", scalars.clamp(v, -1.5, 2.5).alias("clamped"), scalars.lerp(F.lit(2.0), v, F.lit(0.25)).alias("lerped"), scalars.floor32(v).alias("floored"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'DEFAULT' WHEN 1 THEN 'HYBRID(cpu-huffman)' WHEN 2 THEN 'GPU_HYBRID(cuda-cores)' WHEN 3 THEN 'HARDWARE(nvjpg-engine)' ELSE 'backend(' || p_size % 5 || ')' END AS backend,
  CASE WHEN p_size * 2 > 50 THEN 'cuda' ELSE 'cpu' END AS device, greatest(1, CAST(p_size - 10 AS INT)) AS pool,
  CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'choose one preprocess backend' END AS error FROM part""")
def settings(spark, d):
    n = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", scalars.backend_name(n % 5).alias("backend"), scalars.device_label(n * 2).alias("device"), validation.at_least_one(n - 10).alias("pool"), validation.settings_error(n % 2 == 0, n % 3 == 0).alias("error")
    )


@query("""SELECT event_id, list_filter(list_transform(string_split(s, ','), lambda t: CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN TRY_CAST(trim(t) AS BIGINT) END), lambda x: x IS NOT NULL) AS ints
FROM (SELECT event_id, event_id || ', ' || user_id || ',x, 1.5,' || event_type || ', -' || user_id || ',,+7 ' AS s FROM events)""")
def parse_int_list(spark, d):
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = F.concat(i, F.lit(", "), u, F.lit(",x, 1.5,"), F.col("event_type"), F.lit(", -"), u, F.lit(",,+7 "))
    return table(spark, d, "events").select("event_id", scalars.parse_ints(text).alias("ints"))


@query("SELECT CAST(i - 1 AS INT) AS class_index, n_name AS class_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation)")
def label_file(spark, d):
    """A label file's text, made of the nations, read as labels."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.concat(F.lit(" "), r["n_name"], F.lit("\r")))
    return table(spark, d, "nation").agg(F.concat(F.array_join(names, "\n"), F.lit("\n")).alias("text")).select(inputs.label_rows(F.col("text")))


# Requests, from events.
REQUESTS = """requests AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us, value, CAST(floor(value * 1000000) AS BIGINT) AS latency_ns,
         CAST(floor(value * 60) AS BIGINT) * 1000000 AS service_us, [1, 4, 16, 64][1 + user_id % 4] AS level, event_type <> 'error' AS ok FROM events)"""
#: Microseconds of a day: a key takes its rows' batches within this of their first.
WAIT_US, MAX_BATCH, SLOTS = 3_600_000_000, 8, 2


def requests(spark, d) -> DataFrame:
    value = F.col("value")
    return table(spark, d, "events").select(
        "event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "value", F.floor(value * 1000000).cast("bigint").alias("latency_ns"),
        (F.floor(value * 60).cast("bigint") * 1000000).alias("service_us"), F.element_at(F.array(*map(F.lit, (1, 4, 16, 64))), (F.col("user_id") % 4 + 1).cast("int")).alias("level"), (F.col("event_type") != "error").alias("ok"),
    )


def elapsed():
    """Of a level's rows, seconds from the first to the last."""
    return (F.max("ts_us") - F.min("ts_us")) / 1e6


RANKS = ", ".join(f"s[1 + CAST(least(floor({q}::DOUBLE * len(s)), len(s) - 1) AS BIGINT)] AS {n}_ns" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
MS = ", ".join(f"({n}_ns // 1000) / 1000.0::DOUBLE AS {n}_ms" for n in ("p50", "p95", "p99"))


@query(f"""WITH {REQUESTS}, g AS (
  SELECT level, count(*) AS requests, count(*) FILTER (NOT ok) AS errors, (max(ts_us) - min(ts_us)) / 1e6 AS elapsed_sec, list_sort(list(latency_ns)) AS s, CAST(sum(latency_ns) AS BIGINT) AS total FROM requests GROUP BY level),
p AS (SELECT *, {RANKS} FROM g)
SELECT CAST(level AS INT) AS concurrency, requests, errors, elapsed_sec, ((total // requests) // 1000) / 1000.0::DOUBLE AS mean_ms, {MS}, (s[-1] // 1000) / 1000.0::DOUBLE AS max_ms,
       round((requests - errors) / elapsed_sec, 9) AS throughput_req_s FROM p""")
def latency_summary(spark, d):
    rows = requests(spark, d).withColumnRenamed("level", "concurrency")
    out = stats.closed_loop(rows, "concurrency", "latency_ns", "ok", elapsed())
    return out.select("concurrency", "requests", "errors", "elapsed_sec", "mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms", F.round("throughput_req_s", 9).alias("throughput_req_s"))


ADMITTED = f"""walk AS (
  SELECT event_type, i, event_id, service_us, TRUE AS admitted, [ts_us + service_us] AS ends FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.event_type, o.i, o.event_id, o.service_us, len(list_filter(w.ends, lambda e: e > o.ts_us)) < {SLOTS},
         CASE WHEN len(list_filter(w.ends, lambda e: e > o.ts_us)) < {SLOTS} THEN list_append(list_filter(w.ends, lambda e: e > o.ts_us), o.ts_us + o.service_us) ELSE list_filter(w.ends, lambda e: e > o.ts_us) END
  FROM walk w JOIN ordered o ON o.event_type = w.event_type AND o.i = w.i + 1)"""
ORDERED = "ordered AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts_us, event_id) AS i FROM requests)"


@query(f"WITH RECURSIVE {REQUESTS}, {ORDERED}, {ADMITTED} SELECT event_id, event_type, admitted FROM walk")
def admission_replay(spark, d):
    rows = requests(spark, d).select("event_id", "event_type", "ts_us", "service_us")
    return replay.admission(rows, "event_type", "ts_us", "event_id", "service_us", SLOTS).select("event_id", "event_type", "admitted")


@query(f"WITH RECURSIVE {REQUESTS}, {ORDERED}, {ADMITTED} SELECT event_type, count(*) FILTER (admitted) AS accepted, count(*) FILTER (NOT admitted) AS rejects FROM walk GROUP BY event_type")
def admission_rejects(spark, d):
    return admission_replay(spark, d).groupBy("event_type").agg(F.count_if("admitted").alias("accepted"), F.count_if(~F.col("admitted")).alias("rejects"))


@query(f"""WITH RECURSIVE {REQUESTS}, {ORDERED}, {ADMITTED},
sent AS (SELECT r.event_type, r.latency_ns, r.value < 300 AS ok, NOT w.admitted AS overrun FROM walk w JOIN requests r USING (event_id)),
span AS (SELECT event_type, (max(ts_us) - min(ts_us)) / 1e6 AS sec FROM requests GROUP BY event_type),
g AS (SELECT event_type, count(*) FILTER (NOT overrun AND ok) AS completed, count(*) FILTER (NOT overrun AND NOT ok) AS errors, count(*) FILTER (overrun) AS overruns,
             list_sort(list(latency_ns) FILTER (NOT overrun AND ok)) AS s, CAST(sum(latency_ns) FILTER (NOT overrun AND ok) AS BIGINT) AS total FROM sent GROUP BY event_type),
p AS (SELECT *, {RANKS} FROM g)
SELECT event_type, completed, errors, overruns, round(completed / sec, 9) AS achieved, coalesce(((total // completed) // 1000) / 1000.0::DOUBLE, 0) AS mean_ms,
       {', '.join(f'coalesce(({n}_ns // 1000) / 1000.0::DOUBLE, 0) AS {n}_ms' for n in ('p50', 'p95', 'p99'))} FROM p JOIN span USING (event_type)""")
def open_loop_summary(spark, d):
    rows = requests(spark, d).select("event_id", "event_type", "ts_us", "service_us", "latency_ns", (F.col("value") < 300).alias("ok"))
    sent = replay.settled(replay.admission(rows, "event_type", "ts_us", "event_id", "service_us", SLOTS).withColumn("overrun", ~F.col("admitted")))
    out = stats.open_loop(sent, "event_type", "latency_ns", "ok", "overrun", elapsed())
    return out.select("event_type", "completed", "errors", "overruns", F.round("achieved", 9).alias("achieved"), "mean_ms", "p50_ms", "p95_ms", "p99_ms")


BATCHED = f"""walk AS (
  SELECT event_type, i, event_id, ts_us, latency_ns, ok, CAST(0 AS BIGINT) AS batch_id, 0 AS pos, ts_us AS first_us FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.event_type, o.i, o.event_id, o.ts_us, o.latency_ns, o.ok,
         CASE WHEN w.pos + 1 < {MAX_BATCH} AND o.ts_us <= w.first_us + {WAIT_US} THEN w.batch_id ELSE w.batch_id + 1 END,
         CASE WHEN w.pos + 1 < {MAX_BATCH} AND o.ts_us <= w.first_us + {WAIT_US} THEN w.pos + 1 ELSE 0 END,
         CASE WHEN w.pos + 1 < {MAX_BATCH} AND o.ts_us <= w.first_us + {WAIT_US} THEN w.first_us ELSE o.ts_us END
  FROM walk w JOIN ordered o ON o.event_type = w.event_type AND o.i = w.i + 1)"""
FACTS = f"""closed AS (
  SELECT *, CASE WHEN n = {MAX_BATCH} THEN last_us ELSE first_us + {WAIT_US} END AS close_us FROM (
    SELECT event_type, batch_id, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(sum(ts_us) AS HUGEINT) AS sum_us, CAST(sum(latency_ns) AS BIGINT) AS run_ns, bool_or(NOT ok) AS failed
    FROM walk GROUP BY event_type, batch_id)),
facts AS (SELECT event_type, batch_id, n, first_us // 864000000000 AS epoch, CAST(n * close_us - sum_us AS BIGINT) * 1000 AS wait_ns, run_ns, run_ns + n * 1000 AS lane_ns, run_ns + n * 1500 AS busy_ns,
                 CAST(batch_id % 7 AS BIGINT) * 1000000 AS idle_ns, failed FROM closed)"""


def assigned(spark, d) -> DataFrame:
    rows = requests(spark, d).select("event_id", "event_type", "ts_us", "latency_ns", "ok")
    return replay.microbatch_assign(rows, "event_type", "ts_us", "event_id", MAX_BATCH, WAIT_US)


def batch_facts(spark, d) -> DataFrame:
    n = F.col("n")
    made = assigned(spark, d).groupBy("event_type", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.sum(F.col("ts_us").cast("decimal(38,0)")).alias("sum_us"), F.sum("latency_ns").alias("run_ns"), F.bool_or(~F.col("ok")).alias("failed"))
    close = F.when(n == MAX_BATCH, F.col("last_us")).otherwise(F.col("first_us") + WAIT_US)
    wait = ((n * close).cast("decimal(38,0)") - F.col("sum_us")).cast("bigint") * 1000
    run = F.col("run_ns")
    return made.select("event_type", "batch_id", "n", F.floor(F.col("first_us") / 864000000000).alias("epoch"), wait.alias("wait_ns"), "run_ns", (run + n * 1000).alias("lane_ns"), (run + n * 1500).alias("busy_ns"), (F.col("batch_id") % 7 * 1000000).alias("idle_ns"), "failed")


@query(f"WITH RECURSIVE {REQUESTS}, {ORDERED}, {BATCHED} SELECT event_id, event_type, batch_id, CAST(pos AS INT) AS pos FROM walk")
def microbatch_assign(spark, d):
    return assigned(spark, d).select("event_id", "event_type", "batch_id", "pos")


@query(f"WITH RECURSIVE {REQUESTS}, {ORDERED}, {BATCHED}, {FACTS} SELECT event_type, count(*) AS batches, CAST(sum(n) AS BIGINT) AS requests, round(sum(n) / count(*), 9) AS avg_batch_size FROM facts GROUP BY event_type")
def batch_stats(spark, d):
    return stats.batch_stats(batch_facts(spark, d), ["event_type"]).withColumn("avg_batch_size", F.round("avg_batch_size", 9))


TIMING_SQL = """round(sum(wait_ns) / (sum(n) * 1e6), 6) AS avg_queue_wait_ms, round(coalesce(sum(run_ns) FILTER (NOT failed), 0) / (count(*) * 1e6), 6) AS avg_infer_run_ms,
  round(sum(lane_ns) / (count(*) * 1e6), 6) AS avg_runbatch_ms, round(CASE WHEN sum(busy_ns) + sum(idle_ns) > 0 THEN sum(busy_ns) / (sum(busy_ns) + sum(idle_ns)) ELSE 0 END, 6) AS collector_busy_frac"""
TIMINGS = ("avg_queue_wait_ms", "avg_infer_run_ms", "avg_runbatch_ms", "collector_busy_frac")


@query(f"WITH RECURSIVE {REQUESTS}, {ORDERED}, {BATCHED}, {FACTS} SELECT event_type, epoch, {TIMING_SQL} FROM facts GROUP BY event_type, epoch")
def timing_stats(spark, d):
    """By key and reset epoch."""
    return stats.timing_stats(batch_facts(spark, d), ["event_type", "epoch"]).select("event_type", "epoch", *[F.round(c, 6).alias(c) for c in TIMINGS])


PROGRESS_EVERY = 20


@query(f"""WITH RECURSIVE {REQUESTS}, {ORDERED}, {BATCHED}, {FACTS}, told AS (SELECT event_type, n, row_number() OVER w AS b, sum(n) OVER w AS total FROM facts WINDOW w AS (PARTITION BY event_type ORDER BY batch_id))
SELECT event_type, 'batching: ' || b || ' batches run, avg batch size ' || printf('%.1f', CAST(total AS DOUBLE) / b) || ' (last=' || n || ')' AS line FROM told WHERE b % {PROGRESS_EVERY} = 0""")
def progress_lines(spark, d):
    return stats.progress(batch_facts(spark, d), "event_type", "batch_id", "n", PROGRESS_EVERY)


@query(f"""WITH RECURSIVE {REQUESTS}, {ORDERED}, {BATCHED} SELECT event_id, CASE WHEN bool_or(NOT ok) OVER (PARTITION BY event_type, batch_id) THEN 'inference failed' END AS error FROM walk""")
def fail_batch(spark, d):
    """One failed member fails its batch."""
    rows = assigned(spark, d).withColumn("error", F.when(~F.col("ok"), F.lit(validation.FAILED)))
    return replay.fail_batches(rows, ["event_type", "batch_id"], "error").select("event_id", "error")


@query(f"""WITH {REQUESTS}, stop AS (SELECT max(ts_us) - 86400000000 AS us FROM requests)
SELECT event_id, CASE WHEN ts_us > us OR ts_us + service_us // 4 > us THEN 'engine shutting down' END AS error FROM requests, stop""")
def drain(spark, d):
    """Requests that wait a quarter of their service's time to be taken into a batch, at a stop one day before the last event."""
    rows = requests(spark, d).withColumn("taken_us", F.col("ts_us") + F.expr("service_us div 4"))
    stop = rows.agg(F.max("ts_us") - 86400000000).scalar()
    return replay.drain(rows, "ts_us", "taken_us", stop).select("event_id", "error")


LOOPED = """walk AS (
  SELECT level, i, event_id, latency_ns, CAST(0 AS BIGINT) AS start, list_sort(list_append(list_resize([]::BIGINT[], level - 1, 0), latency_ns)) AS free FROM turns WHERE i = 1
  UNION ALL
  SELECT t.level, t.i, t.event_id, t.latency_ns, w.free[1], list_sort(list_append(w.free[2:], w.free[1] + t.latency_ns)) FROM walk w JOIN turns t ON t.level = w.level AND t.i = w.i + 1)"""


@query(f"""WITH RECURSIVE {REQUESTS}, turns AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY ts_us, event_id) AS i FROM requests WHERE user_id % 4 < 3), {LOOPED}
SELECT event_id, CAST(level AS INT) AS level, start FROM walk""")
def closed_loop_replay(spark, d):
    """As many workers as the level, each sending its next request when the last one is answered."""
    rows = requests(spark, d).where("user_id % 4 < 3").select("event_id", "level", "ts_us", "latency_ns", F.col("level").alias("workers"))
    return replay.closed_loop(rows, "level", ["ts_us", "event_id"], "latency_ns", "workers").select("event_id", "level", "start")


@query("SELECT event_id, CAST((event_id + 1) % 2 AS BIGINT) AS image FROM events")
def round_robin(spark, d):
    return table(spark, d, "events").select("event_id", replay.round_robin(F.col("event_id"), 2).alias("image"))


@query(f"""WITH {REQUESTS} SELECT event_type, round(coalesce(sum(latency_ns) FILTER (ok AND user_id % 3 > 0), 0) / (count(*) FILTER (ok AND user_id % 3 > 0) * 1e6), 6) AS avg_decode_ms,
  round(coalesce(sum(latency_ns // 4) FILTER (ok AND user_id % 3 > 0), 0) / (count(*) FILTER (ok AND user_id % 3 > 0) * 1e6), 6) AS avg_normalize_ms,
  count(*) FILTER (ok AND user_id % 3 > 0) AS preproc_count FROM requests WHERE ok GROUP BY event_type""")
def preprocess_stats(spark, d):
    rows = requests(spark, d).where("ok").withColumn("ok", F.col("user_id") % 3 > 0).withColumn("normalise_ns", F.floor(F.col("latency_ns") / 4).cast("bigint"))
    out = stats.preprocess_stats(rows, ["event_type"], "latency_ns", "normalise_ns", "ok")
    return out.select("event_type", F.round("avg_decode_ms", 6).alias("avg_decode_ms"), F.round("avg_normalize_ms", 6).alias("avg_normalize_ms"), "preproc_count")


STATS_FIELDS = ("avg_batch_size", *TIMINGS, "avg_cpu_decode_ms", "avg_cpu_resize_normalize_ms")


@query(f"""WITH RECURSIVE {REQUESTS}, {ORDERED}, {BATCHED}, {FACTS}, {ADMITTED.replace("walk", "gate")},
t AS (SELECT event_type, count(*) AS batches, CAST(sum(n) AS BIGINT) AS requests, round(sum(n) / count(*), 6) AS avg_batch_size, {TIMING_SQL} FROM facts GROUP BY event_type),
r AS (SELECT event_type, count(*) FILTER (NOT admitted) AS rejects FROM gate GROUP BY event_type),
p AS (SELECT event_type, round(coalesce(sum(latency_ns) FILTER (user_id % 3 > 0), 0) / (count(*) FILTER (user_id % 3 > 0) * 1e6), 6) AS avg_cpu_decode_ms,
  round(coalesce(sum(latency_ns // 4) FILTER (user_id % 3 > 0), 0) / (count(*) FILTER (user_id % 3 > 0) * 1e6), 6) AS avg_cpu_resize_normalize_ms, count(*) FILTER (user_id % 3 > 0) AS preproc_count
  FROM requests WHERE ok GROUP BY event_type)
SELECT event_type, requests, batches, rejects, coalesce(preproc_count, 0) AS preproc_count, {", ".join(f"coalesce({c}, 0) AS {c}" for c in STATS_FIELDS)}
FROM t JOIN r USING (event_type) LEFT JOIN p USING (event_type)""")
def stats_document_fields(spark, d):
    """The whole /stats document, read back into columns."""
    made = stats.stats_document(batch_facts(spark, d), admission_rejects(spark, d), ["event_type"], cpu=preprocess_stats(spark, d))
    schema = ", ".join([f"{c} long" for c in ("requests", "batches", "rejects", "preproc_count")] + [f"{c} double" for c in STATS_FIELDS])
    got = made.select("event_type", F.from_json("document", schema).alias("f")).select("event_type", "f.*")
    return got.select("event_type", "requests", "batches", "rejects", "preproc_count", *[F.round(c, 6).alias(c) for c in STATS_FIELDS])


STATS_KEYS = ("avg_batch_size", *TIMINGS, "avg_gpu_decode_ms", "avg_cpu_normalize_ms", "avg_cpu_decode_ms", "avg_cpu_resize_normalize_ms")
DECODED_SQL = "(SELECT event_type, coalesce(sum({decode}), 0) / (count(*) * 1e6) AS decode_ms, coalesce(sum({normalise}), 0) / (count(*) * 1e6) AS normalise_ms, count(*) AS n FROM requests WHERE ok AND user_id % 3 = {k} GROUP BY event_type)"


@query(f"""WITH RECURSIVE {REQUESTS}, {ORDERED}, {BATCHED}, {FACTS}, {ADMITTED.replace("walk", "gate")},
t AS (SELECT event_type, count(*) AS batches, CAST(sum(n) AS BIGINT) AS requests, round(sum(n) / count(*), 6) AS avg_batch_size, {TIMING_SQL} FROM facts GROUP BY event_type),
r AS (SELECT event_type, count(*) FILTER (NOT admitted) AS rejects FROM gate GROUP BY event_type),
g AS {DECODED_SQL.format(decode="latency_ns", normalise="latency_ns // 4", k=1)}, c AS {DECODED_SQL.format(decode="latency_ns // 2", normalise="latency_ns // 8", k=2)}
SELECT event_type, '{",".join(sorted((*STATS_KEYS, "requests", "batches", "rejects", "preproc_count")))}' AS keys, requests, batches, rejects, coalesce(c.n, 0) AS preproc_count,
  {", ".join(("avg_batch_size", *TIMINGS))}, round(coalesce(g.decode_ms, 0), 6) AS avg_gpu_decode_ms, round(coalesce(g.normalise_ms, 0), 6) AS avg_cpu_normalize_ms,
  round(coalesce(c.decode_ms, 0), 6) AS avg_cpu_decode_ms, round(coalesce(c.normalise_ms, 0), 6) AS avg_cpu_resize_normalize_ms
FROM t JOIN r USING (event_type) LEFT JOIN g USING (event_type) LEFT JOIN c USING (event_type)""")
def stats_document(spark, d):
    """The whole /stats document of a server with both decoders: its keys, and what it says of each."""
    rows = requests(spark, d).where("ok")

    def decoded(k, decode, normalise):
        some = rows.withColumns({"ok": F.col("user_id") % 3 == k, "decode_ns": F.expr(decode), "normalise_ns": F.expr(normalise)})
        return stats.preprocess_stats(some, ["event_type"], "decode_ns", "normalise_ns", "ok")

    made = stats.stats_document(
        replay.settled(batch_facts(spark, d)), admission_rejects(spark, d), ["event_type"], gpu=decoded(1, "latency_ns", "latency_ns div 4"), cpu=decoded(2, "latency_ns div 2", "latency_ns div 8")
    )
    longs = ("requests", "batches", "rejects", "preproc_count")
    schema = ", ".join([f"{c} long" for c in longs] + [f"{c} double" for c in STATS_KEYS])
    got = made.select("event_type", F.array_join(F.json_object_keys("document"), ",").alias("keys"), F.from_json("document", schema).alias("f")).select("event_type", "keys", "f.*")
    return got.select("event_type", "keys", *longs, *[F.round(c, 6).alias(c) for c in STATS_KEYS])


@query("""SELECT event_type, round(avg(u), 6) AS util_avg, CAST(max(u) AS DOUBLE) AS util_max, CAST(max(m) AS INT) AS mem_max, count(u) AS count
FROM (SELECT event_type, CASE WHEN user_id % 11 <> 0 THEN user_id % 101 END AS u, CASE WHEN user_id % 11 <> 0 THEN 1000 + user_id % 977 END AS m FROM events) GROUP BY event_type""")
def gpu_metric_summary(spark, d):
    """Meter lines, one in eleven malformed, parsed and summed up."""
    u = F.col("user_id")
    line = F.when(u % 11 == 0, F.lit("no device")).otherwise(F.concat((u % 101).cast("string"), F.lit(", "), (u % 977 + 1000).cast("string"), F.lit("\n0, 0")))
    rows = table(spark, d, "events").select("event_type", inputs.metric_samples(line).alias("s")).select("event_type", "s.util_pct", "s.mem_mib")
    return stats.meter_summary(rows, ["event_type"], "util_pct", "mem_mib").withColumn("util_avg", F.round("util_avg", 6))


STATUS_ROWS = """(SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'GET' ELSE 'POST' END AS method, event_type <> 'signup' AS admitted,
  CASE WHEN user_id % 7 = 0 THEN 'multipart request without an "image" or "file" field' WHEN octet_length(encode(props)) > 20971520 THEN 'could not read image body: http: request body too large' END AS body_error,
  CASE WHEN event_id % 5 = 0 THEN 'bad' END AS decode_error, CASE WHEN event_type = 'error' THEN 'x' END AS run_error FROM events)"""


@query(f"""SELECT event_id, CAST(CASE WHEN method <> 'POST' THEN 405 WHEN NOT admitted THEN 503 WHEN body_error IS NOT NULL OR decode_error IS NOT NULL THEN 400 WHEN run_error IS NOT NULL THEN 500 ELSE 200 END AS INT) AS status,
  CASE WHEN method <> 'POST' THEN 'use POST with an image body' WHEN NOT admitted THEN 'server busy, retry later' WHEN body_error IS NOT NULL THEN body_error
       WHEN decode_error IS NOT NULL THEN 'could not decode image (expected JPEG or PNG): bad' WHEN run_error IS NOT NULL THEN 'inference failed' END AS message FROM {STATUS_ROWS}""")
def request_status(spark, d):
    u, multipart = F.col("user_id"), F.col("user_id") % 7 == 0
    body = inputs.request_body(F.lit(None).cast("binary"), F.lit(None).cast("binary"), F.col("props").cast("binary"), multipart)
    args = (F.when(u % 10 == 0, "GET").otherwise("POST"), F.col("event_type") != "signup", inputs.body_error(body, multipart), F.when(F.col("event_id") % 5 == 0, F.lit("bad")), F.when(F.col("event_type") == "error", F.lit("x")))
    return table(spark, d, "events").select("event_id", validation.status(*args).alias("status"), validation.message(*args).alias("message"))


@query(f"""SELECT method, count(*) FILTER (method = 'POST' AND admitted AND body_error IS NULL AND decode_error IS NULL AND run_error IS NULL) AS answered, count(*) AS requests FROM {STATUS_ROWS} GROUP BY method""")
def served_requests(spark, d):
    """How many requests of a method were answered with a prediction."""
    rows = request_status(spark, d).join(table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 10 == 0, "GET").otherwise("POST").alias("method")), "event_id")
    return rows.groupBy("method").agg(F.count_if(validation.served(F.col("status"))).alias("answered"), F.count(F.lit(1)).alias("requests"))


@query("""WITH forms AS (
  SELECT event_id, user_id % 2 = 0 AS multipart, CASE WHEN user_id % 4 = 0 THEN props END AS image, CASE WHEN user_id % 3 = 0 THEN 'file ' || event_id END AS file, props AS body FROM events),
chosen AS (SELECT event_id, multipart, CASE WHEN multipart THEN coalesce(image, file) ELSE body END AS body FROM forms)
SELECT event_id, CAST(octet_length(encode(body)) AS INT) AS size, CASE WHEN multipart AND body IS NULL THEN 'multipart request without an "image" or "file" field'
  WHEN octet_length(encode(body)) > 20 THEN 'could not read image body: http: request body too large' END AS error FROM chosen""")
def request_bodies(spark, d):
    """Forms with a picture under either name or neither, raw bodies, and bodies beyond a limit of 20 bytes."""
    u = F.col("user_id")
    image, file = F.when(u % 4 == 0, F.col("props")), F.when(u % 3 == 0, F.concat(F.lit("file "), F.col("event_id").cast("string")))
    multipart = u % 2 == 0
    body = inputs.request_body(image.cast("binary"), file.cast("binary"), F.col("props").cast("binary"), multipart)
    rows = table(spark, d, "events").select("event_id", body.alias("body"), multipart.alias("multipart"))
    return rows.select("event_id", F.octet_length("body").alias("size"), inputs.body_error(F.col("body"), F.col("multipart"), 20).alias("error"))


@query(f"WITH {LABELS}, {TOP1} SELECT vec_id, '{{\"class_index\":' || class_index || CASE WHEN class_name IS NOT NULL THEN ',\"class_name\":\"' || class_name || '\"' ELSE '' END || '}}' AS body FROM top LEFT JOIN labels_ USING (class_index)")
def response_json(spark, d):
    """Bodies without the confidence, whose digits the engines print differently."""
    rows = softmax_top1(spark, d)
    return rows.select("vec_id", sinks.prediction_json(F.col("class_index"), F.col("class_name"), F.lit(None).cast("double")).alias("body"))


@query("SELECT r_regionkey, '{\"status\":\"ok\",\"model_loaded\":true,\"device\":\"' || CASE WHEN r_regionkey * 30 > 50 THEN 'cuda' ELSE 'cpu' END || '\"}' AS document FROM region")
def health_document(spark, d):
    device = scalars.device_label(F.col("r_regionkey") * 30)
    return table(spark, d, "region").select("r_regionkey", F.to_json(F.struct(F.lit("ok").alias("status"), F.lit(True).alias("model_loaded"), device.alias("device"))).alias("document"))


@query(f"""WITH {REQUESTS}, g AS (SELECT CAST(level AS INT) AS level, CAST(sum(latency_ns) AS BIGINT) // count(*) AS ns FROM requests GROUP BY level)
SELECT level, ns / 1e6 AS ms, round(first(ns) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / ns, 9) AS speedup FROM g""")
def speedup_vs_first(spark, d):
    levels = requests(spark, d).groupBy("level").agg(F.floor(F.sum("latency_ns") / F.count(F.lit(1))).cast("bigint").alias("ns")).select("level", scalars.ns_to_ms(F.col("ns")).alias("ms"))
    return stats.speedup(levels, "level", "ms").withColumn("speedup", F.round("speedup", 9))


RESULTS_SQL = f"""{REQUESTS}, g AS (
  SELECT CAST(level AS INT) AS c, count(*) AS n, count(*) FILTER (NOT ok) AS errors, (max(ts_us) - min(ts_us)) / 1e6 AS sec, list_sort(list(latency_ns)) AS s, CAST(sum(latency_ns) AS BIGINT) AS total,
         avg(user_id % 101) AS ua, CAST(max(user_id % 101) AS DOUBLE) AS um, max(1000 + user_id % 977) AS mm FROM requests GROUP BY level), p AS (SELECT *, {RANKS} FROM g),
q AS (SELECT *, {MS}, (n - errors) / sec AS thru, ((total // n) // 1000) / 1000.0::DOUBLE AS mean_ms, (s[-1] // 1000) / 1000.0::DOUBLE AS max_ms FROM p)"""


def results(spark, d) -> DataFrame:
    """A closed loop's result table: a row per level, with its meter's summary."""
    rows, u = requests(spark, d).withColumnRenamed("level", "concurrency"), F.col("user_id")
    out = stats.closed_loop(rows, "concurrency", "latency_ns", "ok", elapsed())
    meter = stats.meter_summary(rows.select("concurrency", (u % 101).alias("u"), (u % 977 + 1000).alias("m")), ["concurrency"], "u", "m")
    meter = meter.selectExpr("concurrency", "util_avg AS gpu_util_avg_pct", "util_max AS gpu_util_max_pct", "mem_max AS gpu_mem_max_mib", "count AS gpu_samples")
    return out.join(meter, "concurrency")


@query(f"""WITH {RESULTS_SQL}
SELECT c AS concurrency, c || ',' || printf('%.2f', thru) || ',' || printf('%.2f', p50_ms) || ',' || printf('%.2f', p95_ms) || ',' || printf('%.2f', p99_ms) || ',' ||
  printf('%.2f', mean_ms) || ',' || printf('%.2f', max_ms) || ',' || printf('%.1f', ua) || ',' || printf('%.1f', um) || ',' || mm || ',' || n || ',' || errors || ',' || printf('%.3f', sec) AS line FROM q""")
def results_csv(spark, d):
    return sinks.csv_lines(results(spark, d))


@query(f"""WITH {RESULTS_SQL} SELECT c AS concurrency, round(thru, 6) AS throughput_req_s, p50_ms, p95_ms, p99_ms, mean_ms, max_ms, round(ua, 6) AS gpu_util_avg_pct, um AS gpu_util_max_pct,
  CAST(mm AS INT) AS gpu_mem_max_mib, n AS gpu_samples, errors, sec AS elapsed_sec, CAST(row_number() OVER (ORDER BY c) - 1 AS INT) AS place FROM q""")
def results_json(spark, d):
    """The result file's JSON array, read back with each row's place in it."""
    kinds = {"d": "long", "f": "double"}
    schema = "array<struct<" + ",".join(f"{c}:{kinds[how[-1]]}" for c, how in sinks.CSV_COLUMNS.items()) + ">>"
    read = sinks.results_json(results(spark, d)).select(F.posexplode(F.from_json("json", schema)).alias("place", "r")).select("place", "r.*")
    whole = {"concurrency": F.col("concurrency").cast("int"), "gpu_mem_max_mib": F.col("gpu_mem_max_mib").cast("int")}
    return read.withColumns(whole | {c: F.round(c, 6) for c in ("throughput_req_s", "gpu_util_avg_pct")})


@query(f"""WITH {RESULTS_SQL} SELECT c AS concurrency, '| ' || printf('%11d', c) || ' | ' || printf('%18.1f', thru) || ' | ' || printf('%8.1f', p50_ms) || ' | ' || printf('%8.1f', p95_ms) || ' | ' || printf('%8.1f', p99_ms) ||
  ' | ' || printf('%9.1f', mean_ms) || ' | ' || printf('%8.1f', max_ms) || ' | ' || printf('%11.0f', ua) || '% | ' || printf('%11.0f', um) || '% | ' || printf('%6d', errors) || ' |' AS line FROM q""")
def results_markdown(spark, d):
    return sinks.table_lines(results(spark, d), sinks.CLOSED_TABLE)


@query("""WITH top AS (SELECT vec_id, list_transform(range(10), lambda c: list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda i: ((3 * i + 5 * c) % 11 - 5) / 8.0::DOUBLE))) AS s FROM embeddings)
SELECT vec_id AS request_id, CAST(CASE WHEN vec_id % 9 = 0 THEN 405 WHEN vec_id % 5 = 0 THEN 503 ELSE 200 END AS INT) AS status,
  CASE WHEN vec_id % 9 = 0 THEN 'use POST with an image body' WHEN vec_id % 5 = 0 THEN 'server busy, retry later' ELSE CAST(list_position(s, list_max(s)) - 1 AS VARCHAR) END AS said FROM top""")
def predict_requests(spark, d):
    """The whole request path; `said` is the error or the class of the body."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("request_id"), F.when(F.col("vec_id") % 9 == 0, "GET").otherwise("POST").alias("method"), (F.col("vec_id") % 5 != 0).alias("admitted"), F.lit(None).cast("string").alias("body_error"), F.col("embedding").alias("input"))
    out = predict.predict(rows, class_labels(spark), scoring.LinearModel(head_weights().astype(np.float32)), CLASS_COUNT, WIDTH)
    return out.select("request_id", "status", F.coalesce(F.get_json_object("body", "$.error"), F.get_json_object("body", "$.class_index")).alias("said"))
