import random

from stratagrid.operators import sampling, stencil
from stratagrid.operators.components import connected_components


def test_despeckle_against_brute_force(spark):
    rng = random.Random(4)
    cells = {(r, c): rng.choice([5.0, 5.01, 9.0]) for r in range(9) for c in range(12) if rng.random() < 0.8}
    table = spark.createDataFrame([("s", r, c, v, r * 12 + c) for (r, c), v in cells.items()], "station_id string, row int, col int, rng double, sample_id long")
    for wrap in (True, False):
        for row in stencil.despeckle(table, 12, wrap).collect():
            around = []
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    c = row["col"] + dc
                    if (dr, dc) != (0, 0) and (n := cells.get((row["row"] + dr, c % 12 if wrap else c))) is not None:
                        around.append(n)
            support = sum(abs(n - row["rng"]) <= 0.02 + 0.006 * row["rng"] for n in around)
            assert (row["available"], row["support"]) == (len(around), support)
            assert row["keep"] == (not (len(around) >= 2 and support < 2))


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300), (None, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_by_chunks(spark):
    """Contracted chunk by chunk: nodes of many chunks, a path, too many links for one chunk, and nodes that are no integers."""
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(1000, 1400)] + [(7, rng.randrange(100)) for _ in range(200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(250)]
    rng.shuffle(edges)
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        before = dict(root)
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    table = spark.createDataFrame(edges, "src int, dst long").repartition(3)
    for chunk in (2, 40, 10_000):
        got = connected_components(table, chunk=chunk)
        assert dict(map(tuple, got.collect())) == root and got.schema["node"].dataType.typeName() == "long"
    names = connected_components(table.selectExpr("concat('n', lpad(src, 5, '0')) AS src", "concat('n', lpad(dst, 5, '0')) AS dst"))
    assert {int(r["node"][1:]): int(r["root"][1:]) for r in names.collect()} == root


def test_dense_rank(spark):
    rows = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(10**6), 500)], "k long")
    got = sorted((r["k"], r["n"]) for r in sampling.dense_rank(rows, "k", "n").collect())
    assert [n for _, n in got] == list(range(500))
