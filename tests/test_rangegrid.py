import random

from stratagrid.operators.rangegrid import carve, select_neighbours


def test_neighbours_at_any_distance(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.choice([rng.randrange(40), rng.randrange(2000), 9000 * k]))) for k in range(60)]
    got = {}
    for r in select_neighbours(spark.createDataFrame([*rows, (99, None)], "id long, at double"), "id", ["at"], 2).collect():
        got[r["station"], r["rank"]] = (r["distance"], r["neighbour"])
    want = {(a, n + 1): x for a, p in rows for n, x in enumerate(sorted((abs(p - q), b) for b, q in rows if b != a)[:2])}
    assert got == want


def test_neighbours_in_space(spark):
    rng = random.Random(6)
    rows = [(k, *[float(rng.randrange(9)) for _ in range(3)]) for k in range(40)] + [(50 + k, 1.0, 1.0, 1.0) for k in range(5)]
    got = {(r["station"], r["rank"]): (r["distance"], r["neighbour"]) for r in select_neighbours(spark.createDataFrame(rows, "id long, x double, y double, z double"), "id", ["x", "y", "z"], 3).collect()}
    want = {(a[0], n + 1): x for a in rows for n, x in enumerate(sorted((sum((p - q) ** 2 for p, q in zip(a[1:], b[1:])) ** 0.5, b[0]) for b in rows if b[0] != a[0])[:3])}
    assert got == want


def test_carve_counts_every_grid(spark):
    samples = spark.createDataFrame([(0, 0, 5.0), (0, 1, 5.0), (1, 1, 9.0)], "u int, v int, rng double")
    grids = [spark.createDataFrame(rows, "u int, v int, r double") for rows in ([(0, 0, 6.0), (1, 1, 9.1)], [(0, 0, 5.2), (0, 1, 50.0)], [(0, 0, 7.0)])]
    got = {(r["u"], r["v"]): (r["votes"], r["dropped"]) for r in carve(samples, grids, 2).collect()}
    assert got == {(0, 0): (2, True), (0, 1): (1, False), (1, 1): (0, False)}
    assert not any(r["dropped"] for r in carve(samples, []).collect())
