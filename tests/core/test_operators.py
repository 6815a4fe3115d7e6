"""Replays, summaries, scoring, files and streams on edges."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidescore.functions import pixels
from tidescore.operators import quantiles, replay, scoring, stats
from tidescore.plans import predict
from tidescore.sources import inputs, sinks
from tidescore.streaming import batcher


def slow_batches(rows, most, wait):
    out, state = [], {}
    for key, ts, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        batch, size, first = state.get(key, (-1, 0, 0))
        if not size or size >= most or ts > first + wait:
            batch, size, first = batch + 1, 0, ts
        out.append((i, batch, size))
        state[key] = batch, size + 1, first
    return sorted(out)


@pytest.mark.parametrize(("most", "wait", "rows_per_batch"), [(8, 50, 7), (1, 50, 10_000), (0, 0, 3), (1000, 0, 64), (5, 10_000_000, 64)])
def test_microbatch(spark, most, wait, rows_per_batch):
    rng = np.random.default_rng(0)
    rows = [(["a", "b", None][int(k)], int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 500), np.sort(rng.integers(0, 4000, 500)), strict=True))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    frame = spark.createDataFrame(rows, "key string, ts long, id long")
    got = sorted((r.id, r.batch_id, r.pos) for r in replay.microbatch_assign(frame, "key", "ts", "id", most, wait).collect())
    assert got == slow_batches(rows, max(1, most), wait)
    assert replay.microbatch_assign(frame.limit(0), "key", "ts", "id", most, wait).count() == 0


@pytest.mark.parametrize("slots", [0, 1, 3])
def test_admission(spark, slots):
    rng = np.random.default_rng(1)
    rows = [("k", int(t), int(s), i) for i, (t, s) in enumerate(zip(np.sort(rng.integers(0, 900, 300)), rng.integers(0, 20, 300), strict=True))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    frame = spark.createDataFrame(rows, "key string, ts long, service long, id long")
    ends, want = [], []
    for _, t, s, i in rows:
        ends = [e for e in ends if e > t]
        ok = slots < 1 or len(ends) < slots
        if ok:
            ends.append(t + s)
        want.append((i, ok))
    assert sorted((r.id, r.admitted) for r in replay.admission(frame, "key", "ts", "id", "service", slots).collect()) == want


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {1: list(range(1500)), 2: [7], 3: [int(10 ** x) for x in rng.uniform(0, 15, 800)], 4: [0] * 100, 5: [5, 5, 5, 2**62, 2**62 - 1]}
    rows = [(k, v) for k, some in values.items() for v in some] + [(6, None)]
    qs = [0.0, 0.29, 0.5, 0.95, 0.99, 1.0]
    got = {(r.k, r.q): r.v for r in quantiles.quantiles(spark.createDataFrame(rows, "k int, v long"), "k", "v", qs).collect()}
    assert got == {(k, q): sorted(some)[min(int(q * len(some)), len(some) - 1)] for k, some in values.items() for q in qs}


def test_summaries(spark):
    rows = spark.createDataFrame([(1, 1_999_999, True), (1, 1_000_000, True), (1, 5, False), (2, 10, False)], "level int, ns long, ok boolean")
    span = spark.createDataFrame([(1, 0.5), (2, 0.0)], "level int, elapsed_sec double")
    got = {r.level: r for r in stats.closed_loop(rows, "level", "ns", "ok", span).collect()}
    assert (got[1].requests, got[1].errors, got[1].throughput_req_s, got[1].mean_ms, got[1].max_ms, got[1].p50_ms) == (3, 1, 4.0, 1.0, 1.999, 1.0)
    assert (got[2].throughput_req_s, got[2].p99_ms) == (0.0, 0.0)
    empty = stats.meter_summary(rows.limit(0), [], "ns", "ns").first()
    assert (empty.util_avg, empty.util_max, empty.mem_max, empty["count"]) == (0.0, 0.0, 0, 0)
    assert stats.batch_stats(spark.createDataFrame([], "n int"), []).first().avg_batch_size == 0.0
    assert stats.timing_stats(spark.createDataFrame([], "n int, wait_ns long, run_ns long, lane_ns long, busy_ns long, idle_ns long, failed boolean"), []).first().collector_busy_frac == 0.0
    opened = stats.open_loop(rows.withColumn("over", F.lit(False)), "level", "ns", "ok", "over", span)
    assert {(r.level, r.completed, r.errors, r.p50_ms) for r in opened.collect()} == {(1, 2, 1, 1.999), (2, 0, 1, 0.0)}


def test_stats_document(spark):
    import json

    facts = spark.createDataFrame([("a", 4, 8_000_000, 2_000_000, 3_000_000, 3_000_000, 1_000_000, False), ("a", 2, 1_000_000, 0, 0, 1_000_000, 0, True)], "k string, n int, wait_ns long, run_ns long, lane_ns long, busy_ns long, idle_ns long, failed boolean")
    rejects = spark.createDataFrame([("a", 5), (None, 7)], "k string, rejects long")
    decoded = spark.createDataFrame([("a", 2.0, 1.0, 9)], "k string, avg_decode_ms double, avg_normalize_ms double, preproc_count long")
    base = {"avg_batch_size": 3.0, "avg_infer_run_ms": 1.0, "avg_queue_wait_ms": 1.5, "avg_runbatch_ms": 1.5, "batches": 2, "collector_busy_frac": 0.8, "rejects": 5, "requests": 6}
    gpu, cpu = {"avg_gpu_decode_ms": 2.0, "avg_cpu_normalize_ms": 1.0}, {"avg_cpu_decode_ms": 2.0, "avg_cpu_resize_normalize_ms": 1.0}
    for given, keys in (({}, {}), ({"gpu": decoded}, gpu | {"preproc_count": 9}), ({"cpu": decoded}, cpu | {"preproc_count": 9}), ({"gpu": decoded, "cpu": decoded.withColumn("preproc_count", F.lit(3))}, gpu | cpu | {"preproc_count": 3})):
        got = {r.k: json.loads(r.document) for r in stats.stats_document(facts, rejects, ["k"], **given).collect()}
        assert got["a"] == base | keys and list(got["a"]) == sorted(got["a"])
        assert got[None] == dict.fromkeys(base | keys, 0) | {"rejects": 7}
    assert json.loads(stats.stats_document(facts.limit(0), rejects.agg(F.sum("rejects").alias("rejects")), []).first().document)["rejects"] == 12


def test_sums_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, 2**62, True)] * 4, "level int, ns long, ok boolean")
    assert stats.latencies(rows, "level", "ns").first().mean_ms == pytest.approx(2**62 / 1e6)
    facts = spark.createDataFrame([(1, 2**62, 2**62, 2**62, 2**62, 0, False)] * 4, "n int, wait_ns long, run_ns long, lane_ns long, busy_ns long, idle_ns long, failed boolean")
    got = stats.timing_stats(facts, []).first()
    assert list(got) == pytest.approx([2**62 / 1e6] * 3 + [1.0])
    assert stats.preprocess_stats(rows, ["level"], "ns", "ns", "ok").first().avg_decode_ms == pytest.approx(2**62 / 1e6)


class RunSizes:
    key = ("run sizes",)

    def open(self):
        return lambda x: np.full((len(x), 1), len(x), x.dtype)


def test_runs_are_bounded_whatever_the_session_says(spark):
    rows = spark.range(0, 100, 1, 1).selectExpr("id", "array(float(id)) AS v")
    scored = scoring.score(rows, "v", RunSizes(), 1, 1, max_batch=32)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        sizes = [int(r.logits[0]) for r in scored.orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sizes == [32] * 64 + [6] * 6 + [30] * 30


def test_result_tables(spark, tmp_path):
    row = {"concurrency": 16, "throughput_req_s": 342.125, "p50_ms": 0.25, "p95_ms": 1.0, "p99_ms": 2.0, "mean_ms": 0.5, "max_ms": 3.0, "gpu_util_avg_pct": 0.25, "gpu_util_max_pct": 99.0, "gpu_mem_max_mib": 512, "gpu_samples": 7, "errors": 0, "elapsed_sec": 1.0}
    frame = spark.createDataFrame([row, row | {"concurrency": 4}])
    assert [r.line for r in sinks.csv_lines(frame).orderBy("concurrency").collect()][1] == "16,342.12,0.25,1.00,2.00,0.50,3.00,0.2,99.0,512,7,0,1.000"
    table = sinks.markdown(frame, sinks.CLOSED_TABLE).splitlines()
    assert table[0].startswith("| Concurrency | Throughput (req/s) |") and table[1].startswith("|------------:|") and table[3].startswith("|          16 |")
    sinks.write_results(frame, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == list(sinks.CSV_COLUMNS)
    assert spark.read.json(f"{tmp_path}/json").count() == 2


# scoring


def onnx_matmul(weights: np.ndarray) -> bytes:
    """A model file with one MatMul, encoded by hand: x [N, k] to y [N, c]."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda i, b: number(i << 3 | 2) + number(len(b)) + b
    plain = lambda i, n: number(i << 3) + number(n)
    k, c = weights.shape
    dims = lambda last: field(2, field(1, field(2, b"N")) + field(1, plain(1, last)))
    value = lambda name, last: field(1, name) + field(2, field(1, plain(1, 1) + dims(last)))
    tensor = plain(1, k) + plain(1, c) + plain(2, 1) + field(8, b"w") + field(9, weights.astype("<f4").tobytes())
    node = field(1, b"x") + field(1, b"w") + field(2, b"y") + field(4, b"MatMul")
    graph = field(1, node) + field(2, b"g") + field(5, tensor) + field(11, value(b"x", k)) + field(12, value(b"y", c))
    return plain(1, 7) + field(7, graph) + field(8, plain(2, 13))


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


@pytest.mark.parametrize("most", [1, 7, 32, 1000])
def test_models_agree_at_every_batch_size(vectors, most, tmp_path):
    weights = np.random.default_rng(0).normal(size=(64, 10)).astype(np.float32)
    (tmp_path / "m.onnx").write_bytes(onnx_matmul(weights))
    want = {r.vec_id: np.array(r.embedding, np.float32) @ weights for r in vectors.collect()}
    for model in (scoring.LinearModel(weights), scoring.OnnxModel.load(str(tmp_path / "m.onnx"))):
        rows = scoring.score(vectors.repartition(3), "embedding", model, 64, 10, max_batch=most).collect()
        assert len(rows) == len(want)
        for r in rows:
            assert r.error is None and np.allclose(r.logits, want[r.vec_id], atol=1e-4)


class Broken:
    key = "broken"

    def open(self):
        return lambda x: np.zeros((len(x), 3))


def test_errors_stay_with_their_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [])], "id int, x array<float>")
    eye = scoring.LinearModel(np.eye(2, dtype=np.float32))
    got = {r.id: (r.logits, r.error) for r in scoring.score(frame, "x", eye, 2, 2).collect()}
    assert got == {1: ([1.0, 2.0], None), 2: (None, "input length 1, want 2"), 3: (None, "input length 0, want 2"), 4: (None, "input length 0, want 2")}
    assert {r.error for r in scoring.score(frame.where("id = 1"), "x", Broken(), 2, 2).collect()} == {"inference failed"}
    with pytest.raises(ValueError, match="got 3 logits"):
        scoring.split_logits(np.zeros(3), 1, 2)


def test_no_row_swaps(spark):
    """A thousand rows whose class is their number, scored in batches of 16, in any order."""
    frame = spark.range(1000).select("id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("id") % 10, 10.0).otherwise(0.0).cast("float")).alias("x"))
    eye = scoring.LinearModel(np.eye(10, dtype=np.float32))
    rows = predict.top1(scoring.score(frame.repartition(7).orderBy(F.xxhash64("id")), "x", eye, 10, 10, max_batch=16)).collect()
    assert len(rows) == 1000 and all(r.class_index == r.id % 10 for r in rows)


def test_predict(spark):
    labels = spark.createDataFrame([(0, "crane"), (1, "crane")], "class_index int, class_name string")
    rows = [(1, "POST", True, None, [3.0, 1.0, 0.0]), (2, "GET", True, None, [0.0] * 3), (3, "POST", False, None, [0.0] * 3), (4, "POST", True, "bad body", None), (5, "POST", True, None, [1.0]), (6, "POST", True, None, [0.0, 0.0, 5.0])]
    frame = spark.createDataFrame(rows, "request_id int, method string, admitted boolean, body_error string, input array<float>")
    got = {r.request_id: (r.status, json.loads(r.body)) for r in predict.predict(frame, labels, scoring.LinearModel(np.eye(3, dtype=np.float32)), 3, 3).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 200, 2: 405, 3: 503, 4: 400, 5: 500, 6: 200}
    assert got[1][1]["class_name"] == "crane" and got[1][1]["confidence"] == pytest.approx(0.8437947)
    assert "class_name" not in got[6][1] and got[6][1]["class_index"] == 2
    assert got[5][1] == {"error": "inference failed"} and got[4][1] == {"error": "bad body"}


# files


def test_label_file(spark, tmp_path):
    file = tmp_path / "labels.txt"
    file.write_text("tench\n goldfish \r\ncrane\ncrane\n")
    assert [tuple(r) for r in inputs.labels(spark, str(file)).collect()] == [(0, "tench"), (1, "goldfish"), (2, "crane"), (3, "crane")]
    file.write_text("a\nb")
    assert inputs.labels(spark, str(file)).count() == 2


@pytest.fixture(scope="module")
def picture_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(3)
    made = {"rgb.png": rng.integers(0, 256, (30, 41, 3)), "alpha.png": np.full((5, 6, 4), (200, 100, 50, 128)), "dot.png": rng.integers(0, 256, (1, 1, 3)), "line.png": rng.integers(0, 256, (1, 9, 3))}
    for name, p in made.items():
        (folder / name).write_bytes(pixels.encode_png(p.astype(np.uint8)))
    jvm = spark.sparkContext._jvm
    picture = jvm.java.awt.image.BufferedImage(64, 48, 1)
    for y in range(48):
        for x in range(64):
            picture.setRGB(x, y, (x * 4) << 16 | (y * 5) << 8 | 128)
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(folder / "photo.jpg")))
    (folder / "broken.jpg").write_text("not an image")
    return folder, made


def test_image_source(spark, picture_folder):
    folder, made = picture_folder
    rows = scoring.preprocess_images(inputs.images(spark, str(folder)), "default", 32, 28).collect()
    by = {r.origin.rsplit("/", 1)[1]: r for r in rows}
    assert len(by) == 6 and by["broken.jpg"].input is None and by["broken.jpg"].error.startswith("could not decode image")
    for name, p in made.items():
        want = pixels.preprocess(pixels.to_rgb(p.astype(np.uint8)), "default", 32, 28)
        assert np.allclose(by[name].input, want.ravel(), atol=1e-6)
    photo = np.zeros((48, 64, 3), np.uint8)
    photo[..., 0], photo[..., 1], photo[..., 2] = np.arange(64) * 4, (np.arange(48) * 5)[:, None], 128
    off = np.abs(np.array(by["photo.jpg"].input) - pixels.preprocess(photo, "default", 32, 28).ravel()) * 255 * 0.225
    assert off.mean() < 3
    assert inputs.images(spark, str(folder), drop_invalid=True).count() == 5


def test_binary_source(spark, picture_folder):
    folder, made = picture_folder
    for mode in ("default", "cpu"):
        rows = scoring.preprocess_images(inputs.image_files(spark, str(folder), "*.png"), mode, 32, 28).collect()
        assert len(rows) == 4 and all(r.error is None and len(r.input) == 3 * 28 * 28 for r in rows)
    assert scoring.preprocess_images(inputs.image_files(spark, str(folder), "*.jpg").where("length < 20"), "default", 32, 28).first().error is not None


def test_bodies(spark):
    rows = spark.createDataFrame([(b"i", b"f", b"b", True), (None, b"f", b"b", True), (None, None, b"b", True), (None, None, b"b", False)], "image binary, file binary, body binary, form boolean")
    body = inputs.request_body(F.col("image"), F.col("file"), F.col("body"), F.col("form"))
    got = rows.select(body, inputs.body_error(body, F.col("form"))).collect()
    assert [r[0] and bytes(r[0]) for r in got] == [b"i", b"f", None, b"b"] and [r[1] is None for r in got] == [True, True, False, True]
    assert spark.range(1).select(inputs.body_error(F.repeat(F.lit("x"), 20 * 1024 * 1024 + 1).cast("binary"), F.lit(False))).first()[0].startswith("could not read")


def test_null_keys_are_keys(spark):
    rows = spark.createDataFrame([(None, 0, 3, "x"), (None, 0, 4, None), ("a", 0, 5, None)], "k string, batch int, id int, error string")
    assert {(r.id, r.error) for r in replay.fail_batches(rows, ["k", "batch"], "error").collect()} == {(3, "x"), (4, "x"), (5, None)}
    timed = spark.createDataFrame([(None, 2_000_000, True), (None, 4_000_000, True), (1, 6_000_000, False), (2, None, True)], "level int, ns long, ok boolean")
    assert {(r.level, r.mean_ms, r.p50_ms, r.max_ms) for r in stats.latencies(timed, "level", "ns").collect()} == {(None, 3.0, 4.0, 4.0), (1, 6.0, 6.0, 6.0), (2, 0.0, None, None)}
    span = spark.createDataFrame([(None, 0.5), (1, 1.0), (2, 1.0)], "level int, elapsed_sec double")
    want = {(None, 2, 0, 4.0), (1, 1, 1, 0.0), (2, 1, 0, 1.0)}
    assert {(r.level, r.requests, r.errors, r.throughput_req_s) for r in stats.closed_loop(timed, "level", "ns", "ok", span).collect()} == want
    opened = stats.open_loop(timed.withColumn("over", F.lit(False)), "level", "ns", "ok", "over", F.lit(2.0) * F.count(F.lit(1))).collect()
    assert {(r.level, r.completed, r.errors, r.achieved, r.p99_ms) for r in opened} == {(None, 2, 0, 0.5, 4.0), (1, 0, 1, 0.0, 0.0), (2, 1, 0, 0.5, 0.0)}


def test_drain(spark):
    rows = spark.createDataFrame([(1, 5, 8), (2, 5, 10), (3, 5, 11), (4, 10, 10), (5, 11, 11), (6, 11, 9)], "id int, ts long, taken long")
    said = {r.id: r.error for r in replay.drain(rows, "ts", "taken", 10).collect()}
    assert [said[i] for i in range(1, 7)] == [None, None, "engine shutting down", None, "engine shutting down", "engine shutting down"]


def test_closed_loop_keeps_every_worker_busy(spark):
    rows = [(k, i, int(x), {"a": 1, "b": 3, None: 0}[k]) for k in ("a", "b", None) for i, x in enumerate(np.random.default_rng(5).integers(1, 50, 40))]
    got = {(r.k, r.i): r.start for r in replay.closed_loop(spark.createDataFrame(rows, "k string, i long, ns long, workers int"), "k", ["i"], "ns", "workers").collect()}
    for k, workers in (("a", 1), ("b", 3), (None, 1)):
        busy = [0] * workers
        for _, i, x, _ in (r for r in rows if r[0] == k):
            w = busy.index(min(busy))
            assert got[k, i] == busy[w]
            busy[w] += x


def test_progress(spark):
    rows = spark.createDataFrame([("a", i, 1 + i % 3) for i in range(401)] + [(None, i, 4) for i in range(200)], "k string, b int, n int")
    said = sorted((str(r.k), r.line) for r in stats.progress(rows, "k", "b", "n").collect())
    assert said == [("None", "batching: 200 batches run, avg batch size 4.0 (last=4)"), ("a", "batching: 200 batches run, avg batch size 2.0 (last=2)"), ("a", "batching: 400 batches run, avg batch size 2.0 (last=1)")]


def test_jpeg_through_the_image_source(spark, tmp_path):
    """A JPEG written by the JVM, read by Spark's image source, against its own picture and through both modes."""
    jvm, rng = spark._jvm, np.random.default_rng(3)
    picture = np.kron(rng.integers(0, 256, (10, 8, 3)), np.ones((32, 32, 1))).astype(np.uint8)
    image = jvm.java.awt.image.BufferedImage(picture.shape[1], picture.shape[0], 1)
    for y in range(0, picture.shape[0], 32):
        for x in range(0, picture.shape[1], 32):
            graphics = image.createGraphics()
            graphics.setColor(jvm.java.awt.Color(*map(int, picture[y, x])))
            graphics.fillRect(x, y, 32, 32)
    folder = tmp_path / "jpeg"
    folder.mkdir()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(folder / "a.jpg")))
    (folder / "b.jpg").write_bytes(b"\xff\xd8\xff broken")
    read = inputs.images(spark, str(folder))
    assert read.count() == 2 and inputs.images(spark, str(folder), drop_invalid=True).count() == 1
    for mode in ("default", "turbo"):
        rows = {r.height: r for r in scoring.preprocess_images(read, mode).collect()}
        assert rows[-1].error is not None and rows[320].error is None
        got, want = np.array(rows[320].input).reshape(3, 224, 224), pixels.preprocess(picture, mode)
        assert np.abs(got - want).mean() < 0.1 and np.corrcoef(got.ravel(), want.ravel())[0, 1] > 0.99


def test_results_array(spark):
    import json

    row = dict.fromkeys(sinks.CSV_COLUMNS, 1.5) | {"concurrency": 16, "gpu_mem_max_mib": 512, "gpu_samples": 7, "errors": 0}
    text = sinks.results_json(spark.createDataFrame([row, row | {"concurrency": 4}])).first().json
    assert [r["concurrency"] for r in json.loads(text)] == [4, 16] and json.loads(text)[1] == row and "\n" in text


# streams


class Timers:
    """A key's state and timers, and a clock, in place of Spark's."""

    def __init__(self):
        self.now, self.set, self.value = 0, set(), None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.set.add(at)

    def deleteTimer(self, at):
        self.set.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def live(max_batch, max_wait_us, rows):
    """(id, batch) of rows (ms, id) that come one a trigger, their times being those of the clock; timers fire when due."""
    import pandas as pd

    timers, made = Timers(), []
    own = batcher.Batcher(max_batch, max_wait_us)
    own.init(timers)
    for at, i in rows:
        for due in sorted(t for t in timers.set if t <= at):
            timers.now = due
            timers.set.remove(due)
            list(own.handleExpiredTimer(("k",), timers, timers))
        timers.now = at
        (out,) = own.handleInputRows(("k",), iter([pd.DataFrame({"ts_us": [at * 1000], "id": [i]})]), timers)
        made += zip(out["id"], out["batch_id"], strict=True)
        assert len(timers.set) <= 1  # of the open batch alone
    return made


def test_live_timers_belong_to_their_batch():
    rows = [(8 * i, i) for i in range(8)] + [(57, 8), (101, 9), (157, 10), (158, 11), (400, 12)]
    assert live(8, 100_000, rows) == [(i, 0) for i in range(8)] + [(8, 1), (9, 1), (10, 2), (11, 2), (12, 3)]
    assert live(1, 100_000, rows) == [(i, i) for i in range(13)]


def test_a_stale_timer_closes_nothing():
    timers = Timers()
    own = batcher.Batcher(8, 100_000)
    own.init(timers)
    timers.value, timers.now = (1, 3, 57_000, 157), 100
    list(own.handleExpiredTimer(("k",), timers, timers))
    assert timers.value == (1, 3, 57_000, 157)
    timers.now = 157
    list(own.handleExpiredTimer(("k",), timers, timers))
    assert timers.value == (1, 0, 57_000, -1)


def test_live_batches_with_timers(spark, tmp_path):
    """Rows of one time, put into the source before and after the open batch's timer fires: two batches, though the rows' times would fit one."""
    import time

    def put(k):
        spark.createDataFrame([("a", 0, k)], "key string, ts long, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def seen(n):
        until = time.time() + 60
        while spark.table("timed").count() < n and time.time() < until:
            time.sleep(0.2)
        return sorted((r.id, r.batch_id) for r in spark.table("timed").collect())

    put(0)
    stream = inputs.requests(spark, str(tmp_path / "in"), "key string, ts long, id long")
    query = batcher.live_batches(stream, "key", "ts", "id", 8, 500_000).writeStream.format("memory").queryName("timed").outputMode("append")
    query = query.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        assert seen(1) == [(0, 0)]
        time.sleep(4)
        put(1)
        assert seen(2) == [(0, 0), (1, 1)]
    finally:
        query.stop()


def test_live_batches_equal_replay(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(["a", "b", "c"][int(k)], int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 200), np.sort(rng.integers(0, 5000, 200)), strict=True))]
    frame = spark.createDataFrame(rows, "key string, ts long, id long")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = inputs.requests(spark, str(tmp_path / "in"), frame.schema)
    live = batcher.live_batches(stream, "key", "ts", "id", 8, 100, timers=False)
    live.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.id, r.batch_id, r.pos) for r in spark.table("live").collect()) == slow_batches(rows, 8, 100)


def test_windows(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(minutes=m), float(m)) for m in range(180)]
    spark.createDataFrame(rows, "ts timestamp_ntz, value double").write.parquet(str(tmp_path / "in"))
    stream = inputs.requests(spark, str(tmp_path / "in"), "ts timestamp_ntz, value double")
    query = batcher.windowed_metrics(stream, "ts", "value", "1 hour", "10 minutes").writeStream.format("memory").queryName("windows").outputMode("append")
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    closed = sorted((r.n, r["mean"], r.largest) for r in spark.table("windows").collect())
    assert closed == [(60, 29.5, 59.0), (60, 89.5, 119.0)]


def test_score_each_trigger(spark, tmp_path, vectors):
    vectors.write.parquet(str(tmp_path / "in"))
    eye = scoring.LinearModel(np.eye(64, dtype=np.float32))
    score = lambda rows: predict.top1(scoring.score(rows, "embedding", eye, 64, 64)).select("vec_id", "class_index")
    stream = inputs.requests(spark, str(tmp_path / "in"), vectors.schema, max_files=1)
    batcher.score_each_trigger(stream, score, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == vectors.count()


def test_ticks(spark):
    assert inputs.ticks(spark, 5).isStreaming


