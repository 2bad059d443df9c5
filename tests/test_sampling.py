import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import reports, sampling


def test_percentiles_against_numpy(spark):
    rng = random.Random(2)
    for values in ([rng.gauss(0, 3) for _ in range(997)], [1.0, 1.0, 2.0], [5.0], [float(rng.randrange(4)) for _ in range(300)]):
        table = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
        shares = [0.0, 0.5, 0.95, 0.999, 1.0]
        assert sampling.percentiles(table, "v", shares) == pytest.approx(np.percentile(values, [100 * s for s in shares]).tolist())
    assert sampling.percentiles(table.where("v < 0"), "v", [0.5]) == [None]


def test_deviation_of_nothing_is_zero(spark):
    row = reports.deviation(spark.createDataFrame([], "v double"), "v", 1.0, 2.0).first()
    assert row["n"] == 0 and row["rms"] == row["p99_9"] == row["within_near"] == 0.0


def test_systematic_against_a_running_sum(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(0, 500)) for k in rng.sample(range(10**6), 400)]
    table = spark.createDataFrame(rows, "k long, w int").withColumn("w", F.col("w").cast("decimal(12,2)"))
    total, running, want = sum(w for _, w in rows), 0, {}
    for k, w in sorted(rows):
        for t in range(37):
            if running <= (t + 0.5) * total / 37 < running + w:
                want[t] = k
        running += w
    assert {r["target"]: r["k"] for r in sampling.systematic(table, "k", "w", 37).collect()} == want


def test_band_nearest_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.randrange(12), 3, None]), rng.choice([float(rng.randrange(50)), None])) for k in range(150)] + [(900, 500, 1.0)]
    table = spark.createDataFrame(rows, "k long, b int, v double")
    got = {r["k"]: r["nearest"] for r in sampling.band_nearest(table, table, "k", "b", "v", 2).collect()}
    for k, b, v in rows:
        near = [abs(v - w) for j, c, w in rows if j != k and None not in (b, v, c, w) and abs(b - c) <= 2]
        assert got[k] == (min(near) if near else None)


@pytest.mark.parametrize("most", [2_000_000, 60])
def test_band_nearest_in_blocks(spark, monkeypatch, most):
    """Blocks held in arrays, or gone through by windows if they are crowded, give what brute force does; rows are dealt once, not to each band."""
    monkeypatch.setattr(sampling, "BLOCK_ROWS", 20)
    monkeypatch.setattr(sampling, "MOST_IN_BLOCK", most)
    rng = random.Random(9)
    odd = [float("inf"), float("-inf"), None]
    rows = [(k, rng.choice([rng.randrange(-30, 60), 7, None]), rng.choice([float(rng.randrange(50)), rng.random()])) for k in range(250)]
    if most > 60:
        # Repeated keys and infinities.
        rows += [(rng.randrange(200), rng.randrange(-30, 60), rng.choice([*odd, 3.0])) for _ in range(60)] + [(None, 3, 1.0), (700, 3000, float("inf")), (701, 3001, float("inf"))]
    table = spark.createDataFrame(rows, "k long, b int, v double")
    made = sampling.band_nearest(table, table, "k", "b", "v", 3)
    if most > 60:
        assert "Window" not in made._jdf.queryExecution().toString()
    got = {r["k"]: r["nearest"] for r in made.collect()}
    want = {}
    for k, b, v in rows:
        near = [abs(v - w) for j, c, w in rows if None not in (j, k, b, v, c, w) and j != k and abs(b - c) <= 3]
        want.setdefault(k, []).extend(near)
    assert got.keys() == want.keys()
    for k, near in want.items():
        plain = [x for x in near if x == x]
        assert got[k] == (min(plain) if plain else pytest.approx(float("nan"), nan_ok=True) if near else None)


def test_row_bands_and_stride(spark):
    scan = spark.createDataFrame([(r, c) for r in range(11) for c in range(3)], "row int, col int")
    rows = sampling.row_bands(scan, 4, 2).collect()
    for band in range(3):
        assert {r["row"] for r in rows if r["band"] == band} == {r for r in range(11) if band * 4 - 2 <= r < band * 4 + 6}
    assert all(r["core"] == (r["row"] // 4 == r["band"]) for r in rows)
    assert sampling.lattice_stride(scan, 2).count() == 6 * 2


def test_nearest_exact_in_blocks(spark):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 4, (90, 3)).astype(float)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)] + [(None, [1.0, 1.0, 1.0]), (500, None)], "k long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["k"] for r in sampling.nearest_exact(table.where("k < 30"), table, "k", "v", 3, block=7).collect()}
    for q in range(30):
        d = np.linalg.norm(points - points[q], axis=1)
        want = [int(k) for k in np.lexsort((np.arange(90), d)) if k != q][:3]
        assert [got[q, r] for r in (1, 2, 3)] == want
