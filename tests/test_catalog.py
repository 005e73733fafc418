import math
import os

import duckdb
import pytest

from wavemill.plans import catalog

DIR = os.environ.get("WAVEMILL_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


def rows(data, columns):
    order = [columns.index(c) for c in sorted(columns)]
    fix = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted(repr([fix(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(got.fetchall(), columns)


def test_kernel_queries_read_all_components(spark, tmp_path, monkeypatch):
    import numpy as np

    from wavemill.functions import spd
    from wavemill.plans import catalog

    x = np.random.default_rng(5).normal(size=(100, 64)).astype(np.float32)
    label = np.arange(100) // 5 % 10
    x[:, 60] += 10 * (label % 3)  # only this component tells the classes apart
    rows = [(k, int(label[k]), x[k].tolist()) for k in range(100)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    m = x.astype(float).reshape(100, 16, 4)
    want = spd.tangent(spd.estimate(np.einsum("nti,ntj->nij", m, m) / 16, 16))
    for r in catalog.QUERIES["spd_tangent"](spark, str(tmp_path)).collect():
        np.testing.assert_allclose(r.tangent, want[r.vec_id], rtol=1e-9, atol=1e-12)
    assert all(r.y == r.truth for r in catalog.QUERIES["lr_predict"](spark, str(tmp_path)).collect())


def test_signed_rank_adds_up_in_the_order_of_rows(spark, tmp_path):
    """Hundreds of differences tie but for their last digits; the sums are those of the SQL on one thread."""
    import random

    rng = random.Random(4)
    lines = [(k, round(rng.randint(1, 400) * 0.1, 2), rng.randint(0, 10) / 10, 0.0) for k in range(1, 1500) for _ in range(rng.randint(1, 7))]
    rng.shuffle(lines)
    spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double, l_discount double, l_tax double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    c.execute(f"set threads = 1; create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalog.QUERIES["signed_rank"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == c.execute(catalog.ORACLES["signed_rank"]).fetchall()


@pytest.mark.parametrize(("name", "most"), [("predictions_round_trip", 40), ("dumps_round_trip", 40), ("listed_files", None)])
def test_round_trips_write_few_files(spark, tmp_path, monkeypatch, name, most):
    """Rows of all tasks for all sessions: one file a session at most, or a number of files that doesn't follow the sessions'."""
    from wavemill.plans import more

    rows = [(k, 1_700_000_000 + k, k % 60, "view", float(k % 100), "{}") for k in range(2400)]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string").selectExpr("event_id", "timestamp_seconds(t) ts", "user_id", "event_type", "value", "props")
    df.repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(more, "scratch", lambda spark: str(tmp_path / "out"))
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == (60 if name == "listed_files" else 2400 if name.startswith("pred") else 600)
    assert len(list((tmp_path / "out").rglob("*.csv"))) <= (most or 60)
