"""SimHash and embedding near-duplicates against brute force; both on small postings, so that blocks are dealt out."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidescore.llm import common, embedding_dedup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_simhash(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root, strict=True)), key=str)


def test_triples_cover_every_four_positions():
    triples = simhash.position_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in itertools.combinations(range(8), 4))


def test_simhash_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.op3_simhash(docs).collect()), key=str)
    assert got == slow_simhash(rows)
    assert len({r[2] for r in got}) < len(got)


def test_simhash_edges(spark):
    base = "one two three four five six seven eight nine ten " * 30
    rows = [(5, None), (3, ""), (3, " \t\n"), (None, "a"), (9, "a"), (1, "A"), (7, "x y z"), (8, "X  y\nz"), (2, base), (4, base + "eleven"), (None, None), (6, "\u00a0 \u00c4"), (10, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, "fp", 2) for i, t in rows], "doc_id long, text string, fp int, component_id string, entry int")
    assert sorted((tuple(r) for r in simhash.op3_simhash(docs).collect()), key=str) == slow_simhash(rows)
    assert simhash.op3_simhash(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [4, 4096])
def test_links_join_dense_and_sparse_groups(spark, limit):
    rng = np.random.default_rng(0)
    centre = int(rng.integers(0, 2**63))
    near = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))}
    chain = [int(rng.integers(0, 2**63))]
    for k in range(12):
        chain.append(chain[-1] ^ (0b1111 << (5 * k)))
    fps = sorted(near | set(chain) | set(map(int, rng.integers(0, 2**63, 200))))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = common.connected_components(simhash.links(frame, limit), "a", "b").collect()
    want = components(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = dict(map(tuple, found))
    assert [got.get(f, f) for f in fps] == [fps[r] for r in want]


def test_keep_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "A  b", "y"), (3, "c", None), (None, "d", "z")], "doc_id long, text string, source string")
    assert sorted(map(str, (tuple(r) for r in simhash.keep_one_of_each(docs).collect()))) == sorted(map(str, [(1, "a b", "x"), (3, "c", None), (None, "d", "z")]))


def test_keep_one_of_each_by_row(spark):
    rows = [(None, t, None) for t in ("a", "b c", "b  c", "d", None)] + [(None, "a", None), (4, "e", "x"), (4, "f", "x"), (5, "f", "y"), (None, "e", "y"), (6, "g", None), (6, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in simhash.keep_one_of_each(docs).collect()]
    fps = [simhash.fingerprint(t) for _, t, _ in got]
    assert sorted(fps) == sorted({simhash.fingerprint(t) for _, t, _ in rows})  # one of each; no two of these lie within 4 bits
    assert {(4, "e", "x"), (4, "f", "x"), (6, None, "g"), (6, "g", None)} <= set(got) <= set(rows)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = dict(map(tuple, common.connected_components(edges, "a", "b").collect()))
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert common.connected_components(edges.limit(0), "a", "b").count() == 0


def slow_embeddings(rows, threshold=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
            a, b = (np.array(rows[k][1], np.float32).astype(np.float64) for k in (i, j))
            if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                links.append((i, j))
    root = components(len(rows), links)
    n, least = [0] * len(rows), {}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, n[k], least.get(root[k])) for k, (i, _) in enumerate(rows)), key=str)


def got_embeddings(frame, **more):
    return sorted((tuple(r)[:3] for r in embedding_dedup.near_duplicates(frame, **more).collect()), key=str)


def test_embeddings_whole_table(spark, sf):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    frame = frame.unionByName(frame.where("vec_id % 7 = 0").selectExpr("vec_id + 10000 AS vec_id", "transform(embedding, (v, i) -> if(i < 4, v * 1.2f, v)) AS embedding", "label"))
    want = slow_embeddings([(r.vec_id, list(r.embedding)) for r in frame.collect()])
    assert got_embeddings(frame) == want
    assert any(n for _, n, _ in want)


@pytest.mark.parametrize("limit", [8, 2048])
def test_embeddings_dense_group_and_edges(spark, limit):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(0, 0.05, 16)).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(60)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (301, rows[3][1]), (302, [2 * x for x in rows[3][1]]), (303, None), (304, []), (305, [0.0] * 16)]
    rows += [(306, [float("nan")] * 16), (307, [float("inf")] + [0.0] * 15), (308, [None] + [1.0] * 15), (None, rows[70][1]), (309, [1.0, 2.0]), (310, [1.0, 2.0]), (None, None)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node int, n int")
    assert got_embeddings(frame, limit=limit) == slow_embeddings(rows)
    assert embedding_dedup.op10_embedding_dedup(frame.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    k, tables = embedding_dedup.parameters(50_000)
    hasher = embedding_dedup.Hasher(64, k, tables)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(2000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.9 * x + np.sqrt(1 - 0.81) * y
    assert (hasher(x) == hasher(near)).any(axis=1).mean() > 0.92
    apart = np.bitwise_count((hasher.codes(x) ^ hasher.codes(near)).view(np.uint64)).sum(axis=1)
    found = (hasher(x) == hasher(near)).any(axis=1) & (apart <= embedding_dedup.code_distance())
    assert found.mean() > 0.92 and (apart <= embedding_dedup.code_distance()).mean() > 0.995


def test_code_filter_lets_few_unrelated_vectors_meet():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64))
    code = embedding_dedup.Hasher(64, 3, 12).codes(embedding_dedup.unit(x)).view(np.uint64)
    apart = np.bitwise_count(code[:, None] ^ code[None]).sum(axis=2)
    assert (apart <= embedding_dedup.code_distance()).sum() - len(x) < 1e-4 * len(x) ** 2


def test_embeddings_of_extreme_sizes(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, 0.0]), (4, [0.0, 5e-324]), (5, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got_embeddings(frame) == sorted([(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 2, 1)], key=str)


def test_embeddings_equal_sql(spark):
    """The query's own SQL on a table with links, chains, copies and unusable vectors."""
    import duckdb

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.28, 12)).astype(np.float32).tolist()) for i in range(160)]
    rows += [(500, rows[0][1]), (501, None), (502, [0.0] * 12), (503, [float("nan")] + [1.0] * 11), (504, [1.0, 2.0]), (505, [2.0, 4.0])]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = sorted(con.execute(embedding_dedup.SQL).fetchall())
    got = embedding_dedup.op10_embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == want and len({r[2] for r in want}) < 150


def test_components_of_hubs_and_pairs_of_nodes(spark, monkeypatch):
    """A node with most of the edges, larger or smaller than its neighbours, and nodes that are pairs with a null."""
    monkeypatch.setattr(common, "HOT", 3)
    edges = [(0, i) for i in range(1, 200)] + [(900, i) for i in range(300, 400)] + [(500 + i, 501 + i) for i in range(20)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(200)} | {i: 300 for i in [*range(300, 400), 900]} | {500 + i: 500 for i in range(21)}
    assert dict(map(tuple, common.connected_components(frame, "a", "b").collect())) == want
    pairs = frame.selectExpr("struct(if(a = 0, null, a) AS x, a AS y) AS a", "struct(if(b = 0, null, b) AS x, b AS y) AS b")
    assert {r.node.y: r.root.y for r in common.connected_components(pairs, "a", "b").collect()} == want


def test_join_counted(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 30), ("c", 1), ("d", 1)) for i in range(n)], "k string, i int")
    for hot in (1, 2, 3, 10**6):
        old, common.HOT = common.HOT, hot
        try:
            named = rows.groupBy("k").count().withColumn("name", F.upper("k"))
            assert sorted(map(tuple, common.join_counted(rows, named, ["k"], "count").select("k", "i", "name").collect())) == sorted((r.k, r.i, r.k.upper()) for r in rows.collect())
        finally:
            common.HOT = old


def test_names_that_operators_use(spark):
    """Extra columns of any names, those of the operators' own among them, come through the pipeline's stages."""
    from tidescore.llm import mixing

    own = ["id", "_id", "_h1", "_h2", "_k1", "h1", "h2", "c0", "c1", "fp", "first", "rows", "size", "taken", "copy", "key", "part", "root", "text_"]
    rows = [(1, "a b c", "x", *own), (2, "A  b c", "y", *own), (2, "d e", "y", *own), (None, "f", None, *own), (None, "g", None, *own)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *own], samplingRatio=1.0)
    assert sorted(map(str, simhash.keep_one_of_each(docs).collect())) == sorted(str(r) for r in docs.collect() if r.text != "A  b c")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {1, 2, None} and mixed.count() > 0


@pytest.mark.parametrize("slots", [1, 3, 1 << 20])
def test_keep_one_of_each_whatever_the_slots(spark, monkeypatch, slots):
    monkeypatch.setattr(common, "SLOTS", slots)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 5 = 0")).unionByName(docs.where("doc_id % 7 = 0").withColumn("doc_id", F.expr("doc_id + 1000000")))
    rows = docs.collect()
    kept = {i for i, _, c in slow_simhash([(r.doc_id, r.text) for r in rows]) if i == c}
    assert sorted(map(str, simhash.keep_one_of_each(docs).collect())) == sorted({str(r) for r in rows if r.doc_id in kept})
