import numpy as np
from pyspark.sql import functions as F

from stratagrid.llm import neighbours


def test_near_copies_of_a_third_of_the_rows():
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(4500, 64))
    group = rng.permutation(4500)[:1500]
    vectors[group] = rng.normal(size=64) + 0.02 * rng.normal(size=(1500, 64))
    vectors[group[:3]] = vectors[group[3]]
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    centres = neighbours.fit_centres(unit[:2000], rounds=4)
    codes, ids = neighbours._pack(neighbours.codes_of(unit, centres)), np.arange(4500) * 3
    asked = np.sort(np.r_[group[:40], np.setdiff1d(np.arange(4500), group)[:40]])
    query, found, score = neighbours.Scanner(ids[asked], vectors[asked], centres, 5, neighbours.RERANK).scan(ids, codes, vectors)
    for q in asked:
        cosines = (vectors * vectors[q]).sum(axis=1) / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(vectors[q]))
        cosines[q] = -np.inf
        want = np.lexsort((ids, -np.round(cosines, 13)))[:5]
        got = ids[asked][query] == ids[q]
        assert found[got].tolist() == ids[want].tolist()
        assert np.abs(score[got] - cosines[want]).max() < 1e-12


def cosines(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    same = base[10].tolist()
    rows += [(1000 + k, same) for k in range(200)]  # more equal vectors than are reranked
    rows += [(2000, (base[20] * 2.0**700).tolist()), (2050, (base[21] * 2.0**-700).tolist()), (2001, (base[20] * 2.0**-900).tolist())]
    rows += [(3000, [1.0, 2.0, 3.0]), (3001, [1.0, 2.0, 3.1]), (3002, [-1.0, 0.0, 0.5])]  # another length
    rows += [(20, base[40].tolist()), (7, base[7].tolist()), (7, base[8].tolist())]  # ids that repeat
    bad = [(None, same), (4000, None), (4050, []), (4100, [0.0] * 8), (4150, [float("inf")] * 8), (4200, [1.0] * 7 + [None])]
    table = spark.createDataFrame([(a, b, "x", 9) for a, b in rows + bad], "vec_id long, embedding array<double>, query_id string, score int")
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {k for k, _ in rows if k % 50 == 0}
    for q, found in got.items():
        own = min(v for k, v in rows if k == q)
        want = sorted(((-round(cosines(own, v), 12), k) for k, v in rows if k != q and len(v) == len(own)))[:5]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want) + 1))
        assert [k for _, k, _ in found] == [k for _, k in want]
        assert all(abs(s + w) < 1e-9 for (_, _, s), (w, _) in zip(found, want, strict=True))
