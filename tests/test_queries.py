"""Every query against its DuckDB SQL on the driver's tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from tidescore.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, sf, oracle, name):
    frame = entry_points.queries()[name](spark, sf)
    found = oracle.execute(entry_points.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in frame.collect()) == want


#: Floats just below a step of (e + 0.5) * 256, which arithmetic in float rounds up to it, and extreme ones.
ODD = [0.12499997019767761, 0.1406249850988388, 0.2070312350988388, -0.1914062649011612, -0.1093750149011612, 0.5, -0.5, math.nan, math.inf, -math.inf]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    rows = [(k, [ODD[(k + i * i) % len(ODD)] for i in range(64)]) for k in range(20)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["pixel_parity", "png_round_trip", "tile_alpha", "tile_resize_bilinear", "tile_rgb_chw", "tile_scaled_decode"])
def test_pixels_of_odd_floats(spark, odd_tables, name):
    frame = QUERIES[name](spark, odd_tables)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{odd_tables}/embeddings.parquet/*.parquet'")
    found = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(found) != []


@pytest.fixture(scope="module")
def ragged_tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ragged")
    full = [(i * 37 % 256) / 256 - 0.5 for i in range(100)]
    rows = list(enumerate([full[:64], None, [], full[:1], full[:10], full[:47], full[:63], full[:65], full, [None, *full[1:64]]]))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["pixel_parity", "png_round_trip", "tile_alpha", "tile_fused", "tile_normalize_chw", "tile_resize_bilinear", "tile_rgb_chw", "tile_scaled_decode"])
def test_pixels_of_ragged_vectors(spark, ragged_tables, name):
    """Null vectors and those of fewer or more components than a tile has."""
    frame = QUERIES[name](spark, ragged_tables)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{ragged_tables}/embeddings.parquet/*.parquet'")
    found = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({SQL[name]})").fetchall()
    assert Counter(map(tuple, frame.collect())) == Counter(found) != Counter()


def test_normalised_bytes_round_as_in_sql(spark, tmp_path):
    """Each byte in each channel; in float32, byte 52 of green is -1.12535 from the other side."""
    rows = [(b, [(b + 0.5) / 256 - 0.5] * 64) for b in range(256)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    frame = QUERIES["tile_rgb_chw"](spark, str(tmp_path))
    found = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({SQL['tile_rgb_chw']})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(found) != []


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.count() > 0 and frame.columns == ["vec_id", "class_index", "class_name", "confidence"]


def test_library_does_without_training_data_operators():
    import pathlib

    root = pathlib.Path(entry_points.__file__).parent / "tidescore"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "tidescore.llm" not in file.read_text()


def test_plans(spark, sf):
    """Two-column queries read two columns; small sides are broadcast by size; Python runs in Arrow batches only."""
    plan = QUERIES["round_robin"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in plan
    top = QUERIES["softmax_top1"](spark, sf)
    assert "Python" not in top._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in top._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in QUERIES["linear_head_score"](spark, sf)._jdf.queryExecution().executedPlan().toString()
