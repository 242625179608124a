"""Neighbours by cells against brute force."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloam.llm import cells, queries


def _made(n, clustered):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 32))
    if clustered:
        x = x * 0.3 + rng.normal(size=(40, 32))[rng.integers(0, 40, n)]
    return x.astype(np.float32)


def _best(x, asked, k=10):
    """(row of the neighbour, cosine) of each of ``asked``, in order of the cosine and of the row."""
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    like = np.round(x[asked] @ x.T, 12)
    like[np.arange(len(asked)), asked] = -2
    return np.argsort(-like, axis=1, kind="stable")[:, :k], like


def _frame(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_and_cosines(spark, clustered):
    x = _made(6000, clustered)
    asked = np.arange(0, len(x), 50)
    best, like = _best(x, asked)
    got = collections.defaultdict(list)
    # Small blocks and turns, and bounds of a sample smaller than the table.
    for r in cells.nearest(_frame(spark, x), F.col("vec_id") % 50 == 0, sample=1000, block=500, asked=40).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append(r.neighbour_id)
        assert r["rank"] == len(got[r.vec_id]) and abs(r.cosine - like[r.vec_id // 50, r.neighbour_id]) < 1e-6
    assert sorted(got) == asked.tolist() and {len(v) for v in got.values()} == {10}
    assert np.mean([len(set(got[i]) & set(best[k].tolist())) / 10 for k, i in enumerate(asked.tolist())]) >= 0.9


def test_all_cells_are_brute_force(spark):
    x = _made(700, False)
    x[300:320] = x[5]  # equal ones, in order of their ids
    best, _ = _best(x, np.arange(0, 700, 5), 4)
    frame = _frame(spark, x)
    want = [(5 * i, n + 1, int(j)) for i, row in enumerate(best) for n, j in enumerate(row)]
    for block in (50, 100_000):
        found = cells.nearest(frame, F.col("vec_id") % 5 == 0, k=4, recall=1.0, cells=1, sample=100, block=block)
        assert sorted((r.vec_id, r["rank"], r.neighbour_id) for r in found.collect()) == want
    # Ids may be texts, which sort otherwise.
    named = cells.nearest(frame.where("vec_id < 300").withColumn("vec_id", F.concat(F.lit("v"), "vec_id")), F.col("vec_id").endswith("0"), k=4, recall=1.0)
    best, _ = _best(x[:300], np.arange(0, 300, 10), 4)
    assert {(r.vec_id, r.neighbour_id) for r in named.collect()} == {(f"v{10 * i}", f"v{j}") for i, row in enumerate(best) for j in row}


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0] * 8), (50, [1.0, 0.1] * 8), (None, [1.0] * 16), (3, None), (4, [0.0] * 16), (100, [float("nan")] * 16), (6, [1.0]), (7, [None] * 16), (0, [1.0, 0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>").withColumn("_row", F.lit(0))
    asks = F.col("vec_id") % 50 == 0
    got = cells.nearest(df, asks)
    assert {(r.vec_id, r.neighbour_id) for r in got.collect()} == {(0, 50), (50, 0)}
    assert got.dtypes == [("vec_id", "int"), ("neighbour_id", "int"), ("rank", "int"), ("cosine", "double")]
    for none in (df.limit(0), df.where("vec_id in (3, 4, 100)"), df.where("vec_id = 0"), df.where("vec_id = 6")):
        assert cells.nearest(none, asks).count() == 0
    assert cells.nearest(df, F.lit(False)).count() == 0


def test_blocks_are_bounded():
    centres = cells.fit(_made(400, True), 30)
    counts = np.random.default_rng(2).integers(0, 60, 30)
    counts[[3, 17]] = 1000, 401
    first, parts, blocks = cells.blocks_of(centres, counts, 100)
    assert parts[3] == 10 and parts[17] == 5 and (parts[[c for c in range(30) if c not in (3, 17)]] == 1).all()
    load = np.zeros(blocks)
    for c in range(30):
        load[first[c] : first[c] + parts[c]] += counts[c] / parts[c]
    assert load.max() <= 100 and load.sum() == counts.sum()


def test_the_query_asks_for_every_fiftieth_row(spark):
    got = queries.op9_nearest_neighbours(spark, "/root/testdata/sf0.1")
    ids = [r.vec_id for r in got.select("vec_id").distinct().collect()]
    assert sorted(ids) == list(range(0, 2000, 50)) and got.count() == 400
