"""Every stage of the pipeline against a plain version over its own input."""

import re

import corpus_pipeline
import pytest

from tidescore.llm import language_id, quality_rules, sentencepiece_bpe
from tidescore.llm.queries import model_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir = "/root/testdata/sf0.01"
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        frames.append(docs)
    return frames


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_columns(stages):
    assert all(f.columns == stages[0].columns for f in stages[:-1])


def test_language(stages):
    network = language_id.fit(stages[0])
    want = [r for r in stages[0].collect() if (p := network.predict([r.text or ""])[0])[0] != "und" and p[1] >= language_id.MIN_SCORE]
    assert rows(stages[1]) == sorted(map(str, want))


def test_quality(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights = quality_rules.log_ratios(stages[1], labels)
    want = []
    for r in stages[1].collect():
        n = quality_rules.base_counts(r.text)
        if n[0] >= 10 and 100 * n[4] <= 20 * n[0] and quality_rules.score(r.text, weights) >= quality_rules.THRESHOLD:
            want.append(r)
    assert rows(stages[2]) == sorted(map(str, want)) and len(want) < stages[1].count()


def test_deduplicate(stages):
    from tests.llm.test_pairs import slow_simhash

    everything = stages[2].collect()
    kept = {i for i, _, c in slow_simhash([(r.doc_id, r.text) for r in everything]) if i == c}
    assert rows(stages[3]) == sorted(str(r) for r in everything if r.doc_id in kept) and len(kept) < len(everything)


def test_mix(stages):
    from tests.llm.test_text import slow_targets

    sizes, mixed, texts = {}, {}, {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    for r in stages[4].collect():
        mixed[r.source] = mixed.get(r.source, 0) + len(WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text) or texts[r.doc_id].lstrip().startswith(r.text)
    for s, n in slow_targets(sizes).items():
        assert abs(mixed.get(s, 0) - n) <= 0.5


def test_encode(stages):
    own = sentencepiece_bpe.Coder(open(model_path(), "rb").read())
    want = sorted(str((r.doc_id, own.library.encode(r.text))) for r in stages[4].collect())
    assert sorted(str((r.doc_id, list(r.ids))) for r in stages[5].collect()) == want


def test_run(spark, stages):
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()) == sorted(r.ids_sha256 for r in stages[5].collect())


def test_sessions(spark):
    """Operators leave the session's batches alone; entry points change nothing but the default, and always to the same number."""
    from tidescore.llm import chat, common, embedding_dedup, html_extract, license_scan, mixing, quality_classifier, queries, simhash

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sf_dir = "/root/testdata/sf0.001"
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    old = spark.conf.get(rows)
    try:
        spark.conf.set(rows, "10000")
        docs, labels = table("documents"), table("labels")
        for frame in (
            chat.op1_chat(table("conversations")), sentencepiece_bpe.op2_sentencepiece(docs, model_path()), simhash.op3_simhash(docs), mixing.op4_mix(docs), html_extract.op5_html(table("pages")),
            quality_rules.op6_quality_rules(docs, labels), license_scan.op7_license_scan(docs), quality_classifier.op9_quality(docs, labels), embedding_dedup.op10_embedding_dedup(table("embeddings")),
        ):
            frame.limit(1).collect()
            assert spark.conf.get(rows) == "10000"
        queries.queries()["op5_html"](spark, sf_dir)
        assert spark.conf.get(rows) == "1000"
        spark.conf.set(rows, "777")
        queries.queries()["op5_html"](spark, sf_dir)
        assert spark.conf.get(rows) == "777"
        assert common.checkpoint_folder(spark)
    finally:
        spark.conf.set(rows, old)


def test_a_cluster_must_name_its_folder(monkeypatch):
    from types import SimpleNamespace

    from tidescore.llm import common

    unset = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://far:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, other=None: other))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.checkpoint_folder(session)


def test_stage_folders_go(spark):
    import pathlib

    base = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.glob("pipeline-*"))
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    (made,) = set(base.glob("pipeline-*")) - before
    assert [x.name for x in made.iterdir()] == [str(len(corpus_pipeline.STAGES) - 2)]
