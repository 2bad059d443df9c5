"""The registered queries of the scan engine and their SQL.

The driver's tables hold no scans, so queries run the operators over surrogate
views of whole tables: events are a dense lattice of 100 columns (event_id
numbers its cells, value is the range), lineitem gives the many samples of a
range grid. Tolerances fit the surrogate's ranges; the operators' defaults are
those of real scans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagrid.operators import mesh, rangegrid, reports, sampling, stencil, tiling
from stratagrid.operators.components import connected_components
from stratagrid.session import load

COLS = 100
TOL_ABS, TOL_REL = 20.0, 0.1
STEP = 0.9

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def scan(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """events as a lattice; sparse leaves the cells of errors out."""
    events = load(spark, sf_dir, "events")
    events = events.where("event_type <> 'error'") if sparse else events
    return events.select(
        F.lit("s").alias("station_id"),
        F.expr("cast(event_id div 100 as int)").alias("row"),
        (F.col("event_id") % COLS).cast("int").alias("col"),
        F.col("value").alias("rng"),
        F.col("event_id").alias("sample_id"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse lattice as points of a plane with the range as height."""
    return scan(spark, sf_dir, True).select("row", "col", "rng", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), (F.col("rng") / 100).alias("z"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("u"), (F.col("l_suppkey") % 100).alias("v"), (F.col("l_quantity") * 10).alias("rng"))
    return rangegrid.range_grid(samples, ["u", "v"])


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.triangulate(points(spark, sf_dir), COLS, True, STEP, noise_floor=1.0)


_SCAN = "SELECT CAST(event_id // 100 AS INT) AS r, CAST(event_id % 100 AS INT) AS c, value AS rng, event_id AS sample_id FROM events"
_SPARSE = _SCAN + " WHERE event_type <> 'error'"
_OFFSETS = "(SELECT a.x AS dr, b.x AS dc FROM (VALUES (-1),(0),(1)) a(x), (VALUES (-1),(0),(1)) b(x) WHERE a.x <> 0 OR b.x <> 0)"
_GRID = "SELECT l_partkey % 100 AS u, l_suppkey % 100 AS v, min(l_quantity * 10) AS r FROM lineitem WHERE l_quantity * 10 > 1e-6 GROUP BY 1, 2"


def _near(table: str, wrap: bool) -> str:
    col = "(s.c + o.dc + 100) % 100" if wrap else "s.c + o.dc"
    return f"SELECT s.r, s.c, s.rng, n.rng AS nr FROM {table} s CROSS JOIN {_OFFSETS} o LEFT JOIN {table} n ON n.r = s.r + o.dr AND n.c = {col}"


def _despeckle_sql(table: str, wrap: bool) -> str:
    return f"""WITH t AS ({table}), j AS ({_near('t', wrap)}),
g AS (SELECT r, c, rng, count(nr) AS available, count(nr) FILTER (abs(nr - rng) <= {TOL_ABS} + {TOL_REL} * rng) AS support FROM j GROUP BY ALL)
SELECT 's' AS station_id, r AS "row", c AS col, rng, CAST(available AS INT) AS available, CAST(support AS INT) AS support, NOT (available >= 2 AND support < 2) AS keep FROM g"""


@query(_despeckle_sql(_SCAN, True))
def despeckle_wrap(spark, sf_dir):
    return stencil.despeckle(scan(spark, sf_dir), COLS, True, TOL_ABS, TOL_REL)


@query(_despeckle_sql(_SCAN, False))
def despeckle_nowrap(spark, sf_dir):
    return stencil.despeckle(scan(spark, sf_dir), COLS, False, TOL_ABS, TOL_REL)


@query(_despeckle_sql(_SPARSE, True))
def despeckle_sparse(spark, sf_dir):
    return stencil.despeckle(scan(spark, sf_dir, True), COLS, True, TOL_ABS, TOL_REL)


_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


@query(f"""SELECT l_orderkey, l_linenumber, {', '.join(_LINE[:4])} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in _LINE)}) AS n FROM lineitem) WHERE n = 1""")
def scan_dedupe_last(spark, sf_dir):
    rows = stencil.dedupe_last(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE)
    return rows.select("l_orderkey", "l_linenumber", *_LINE[:4])


@query(f"SELECT r AS \"row\", c AS col, rng, sample_id FROM ({_SCAN}) WHERE r % 3 = 0 AND c % 3 = 0")
def stride_subsample(spark, sf_dir):
    return sampling.lattice_stride(scan(spark, sf_dir), 3).drop("station_id")


@query(f"SELECT sample_id, rng, rn - 1 AS ordinal FROM (SELECT *, row_number() OVER (ORDER BY sample_id) AS rn FROM ({_SCAN}) WHERE rng > 1) WHERE (rn - 1) % 7 = 0")
def strided_ordinal_sample(spark, sf_dir):
    return sampling.every_kth(scan(spark, sf_dir).where("rng > 1").select("sample_id", "rng"), "sample_id", 7)


@query("""WITH t AS (SELECT o_orderkey, o_totalprice, sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS cum, sum(o_totalprice) OVER () AS total FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice FROM orders)),
k AS (SELECT unnest(range(100)) AS k) SELECT k.k AS target, o_orderkey FROM k JOIN t ON (2 * k.k + 1) * total >= 200 * (cum - o_totalprice) AND (2 * k.k + 1) * total < 200 * cum""")
def systematic_sample(spark, sf_dir):
    weighted = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("w"))
    return sampling.systematic(weighted, "o_orderkey", "w", 100)


@query(f"SELECT r AS \"row\", c AS col, rng, w.band, r >= w.band * 4 AND r < w.band * 4 + 4 AS core FROM ({_SCAN}) s JOIN (SELECT DISTINCT event_id // 400 AS band FROM events) w ON r >= w.band * 4 - 3 AND r < w.band * 4 + 7")
def row_band_windows(spark, sf_dir):
    return sampling.row_bands(scan(spark, sf_dir).select("row", "col", "rng"), 4, 3)


@query(_GRID)
def range_grid_min(spark, sf_dir):
    return grid(spark, sf_dir)


@query(f"""WITH g AS (SELECT * FROM ({_GRID}) WHERE (u + v) % 3 <> 0), o AS (SELECT a.x AS du, b.x AS dv FROM (VALUES (-1),(0),(1)) a(x), (VALUES (-1),(0),(1)) b(x)),
s AS (SELECT (u + du + 100) % 100 AS u, v + dv AS v, r, du = 0 AND dv = 0 AS own FROM g, o)
SELECT u, v, coalesce(min(r) FILTER (own), min(r)) AS r, min(r) FILTER (own) IS NULL AS filled FROM s WHERE v BETWEEN 0 AND 99 GROUP BY u, v""")
def close_holes(spark, sf_dir):
    return rangegrid.close_holes(grid(spark, sf_dir).where("(u + v) % 3 <> 0"), 100, 100)


def _carved(spark, sf_dir, min_votes=1):
    samples = scan(spark, sf_dir).select("row", "col", "rng", (F.col("row") % 100).alias("v"), F.col("col").alias("u"))
    own = grid(spark, sf_dir)
    return rangegrid.carve(samples, [own, own.select("u", (99 - F.col("v")).alias("v"), "r")], min_votes).select("row", "col", "rng", "votes", "dropped")


_CARVE = f"""WITH g AS ({_GRID}), v AS (SELECT s.r AS "row", c AS col, rng, CAST(coalesce(a.r > rng + 0.4 AND a.r > 1.02 * rng, false) AS INT) + CAST(coalesce(b.r > rng + 0.4 AND b.r > 1.02 * rng, false) AS INT) AS votes
FROM ({_SCAN}) s LEFT JOIN g a ON a.u = c AND a.v = s.r % 100 LEFT JOIN g b ON b.u = c AND 99 - b.v = s.r % 100) SELECT *, votes >= 1 AS dropped FROM v"""


@query(_CARVE)
def carve_votes(spark, sf_dir):
    return _carved(spark, sf_dir)


@query(f"""WITH t AS (SELECT "row" AS r, col AS c, rng, dropped FROM ({_CARVE})),
j AS (SELECT s.r, s.c, s.rng, s.dropped, count(n.rng) FILTER (NOT n.dropped AND abs(n.rng - s.rng) <= {TOL_ABS} + {TOL_REL} * s.rng) AS k FROM t s CROSS JOIN {_OFFSETS} o LEFT JOIN t n ON n.r = s.r + o.dr AND n.c = (s.c + o.dc + 100) % 100 GROUP BY ALL)
SELECT 's' AS station_id, r AS "row", c AS col, rng, dropped, dropped AND k >= 2 AS restored FROM j""")
def restore_parallax(spark, sf_dir):
    return stencil.restore(_carved(spark, sf_dir).withColumn("station_id", F.lit("s")), COLS, True, TOL_ABS, TOL_REL, 2)


@query("""SELECT station, neighbour, rank, distance FROM (SELECT a.s_suppkey AS station, b.s_suppkey AS neighbour, abs(a.s_acctbal - b.s_acctbal) AS distance,
CAST(row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS INT) AS rank FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey) WHERE rank <= 2""")
def select_neighbours(spark, sf_dir):
    return rangegrid.select_neighbours(load(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal"], 2)


_TRI_OF = f"""p AS (SELECT r, c, r * 100 + c AS cell, rng, CAST(c AS DOUBLE) AS x, CAST(r AS DOUBLE) AS y, rng / 100 AS z FROM alive),
k AS (SELECT DISTINCT r - dr AS r, (c - dc + 100) % 100 AS c FROM p, (VALUES (0,0),(0,1),(1,0),(1,1)) o(dr, dc) WHERE r - dr >= 0),
q AS (SELECT k.r, k.c, a.cell AS ac, b.cell AS bc, d.cell AS cc, e.cell AS dc, a, b, d AS cq, e AS dq FROM k
 LEFT JOIN p a ON a.r = k.r AND a.c = k.c LEFT JOIN p b ON b.r = k.r AND b.c = (k.c + 1) % 100
 LEFT JOIN p d ON d.r = k.r + 1 AND d.c = k.c LEFT JOIN p e ON e.r = k.r + 1 AND e.c = (k.c + 1) % 100),
t AS (SELECT r, c, 'bc' AS kind, unnest([{{'p': a, 'q': cq, 'o': b}}, {{'p': b, 'q': cq, 'o': dq}}]) AS t FROM q WHERE ac IS NOT NULL AND bc IS NOT NULL AND cc IS NOT NULL AND dc IS NOT NULL
 UNION ALL SELECT r, c, 'ad', unnest([{{'p': a, 'q': cq, 'o': dq}}, {{'p': a, 'q': dq, 'o': b}}]) FROM q WHERE ac IS NOT NULL AND bc IS NOT NULL AND cc IS NOT NULL AND dc IS NOT NULL
 UNION ALL SELECT r, c, 'one', {{'p': a, 'q': cq, 'o': b}} FROM q WHERE ac IS NOT NULL AND bc IS NOT NULL AND cc IS NOT NULL AND dc IS NULL
 UNION ALL SELECT r, c, 'one', {{'p': a, 'q': dq, 'o': b}} FROM q WHERE ac IS NOT NULL AND bc IS NOT NULL AND cc IS NULL AND dc IS NOT NULL
 UNION ALL SELECT r, c, 'one', {{'p': a, 'q': cq, 'o': dq}} FROM q WHERE ac IS NOT NULL AND bc IS NULL AND cc IS NOT NULL AND dc IS NOT NULL
 UNION ALL SELECT r, c, 'one', {{'p': b, 'q': cq, 'o': dq}} FROM q WHERE ac IS NULL AND bc IS NOT NULL AND cc IS NOT NULL AND dc IS NOT NULL),
l AS (SELECT r, c, kind, t.p.cell AS c0, t.q.cell AS c1, t.o.cell AS c2, greatest(t.p.rng, t.q.rng, t.o.rng) AS far,
 sqrt((t.p.x-t.q.x)**2+(t.p.y-t.q.y)**2+(t.p.z-t.q.z)**2) AS pq, sqrt((t.q.x-t.o.x)**2+(t.q.y-t.o.y)**2+(t.q.z-t.o.z)**2) AS qo, sqrt((t.o.x-t.p.x)**2+(t.o.y-t.p.y)**2+(t.o.z-t.p.z)**2) AS op,
 0.5*sqrt(((t.q.y-t.p.y)*(t.o.z-t.p.z)-(t.q.z-t.p.z)*(t.o.y-t.p.y))**2+((t.q.z-t.p.z)*(t.o.x-t.p.x)-(t.q.x-t.p.x)*(t.o.z-t.p.z))**2+((t.q.x-t.p.x)*(t.o.y-t.p.y)-(t.q.y-t.p.y)*(t.o.x-t.p.x))**2) AS area FROM t),
j AS (SELECT *, greatest(pq, qo, op) < greatest(1.0, far * {STEP} * tan(radians(82.0))) AND 2 * area / (greatest(pq, qo, op) ** 2) > 0.015 AS ok FROM l),
w AS (SELECT j.*, bool_and(ok) OVER (PARTITION BY r, c, kind) AS pair_ok,
 sqrt((q.b.x-q.cq.x)**2+(q.b.y-q.cq.y)**2+(q.b.z-q.cq.z)**2) AS dbc, sqrt((q.a.x-q.dq.x)**2+(q.a.y-q.dq.y)**2+(q.a.z-q.dq.z)**2) AS dad FROM j JOIN q USING (r, c)),
s AS (SELECT *, bool_or(pair_ok AND kind = 'bc') OVER (PARTITION BY r, c) AS can_bc, bool_or(pair_ok AND kind = 'ad') OVER (PARTITION BY r, c) AS can_ad FROM w),
tri AS (SELECT c0, c1, c2, area FROM s WHERE (kind = 'one' AND ok) OR (kind = 'bc' AND can_bc AND (NOT can_ad OR dbc <= dad)) OR (kind = 'ad' AND can_ad AND NOT (can_bc AND dbc <= dad)))"""
_TRI = f"WITH RECURSIVE alive AS ({_SPARSE}), {_TRI_OF}"


@query(_TRI + " SELECT CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, CAST(c2 AS BIGINT) AS c2, round(area, 6) AS area FROM tri")
def quads_triangulated(spark, sf_dir):
    return triangles(spark, sf_dir).withColumn("area", F.round("area", 6))


_EDGES = ", e AS (SELECT least(p, q) AS e0, greatest(p, q) AS e1, count(*) AS uses FROM (SELECT c0 AS p, c1 AS q FROM tri UNION ALL SELECT c1, c2 FROM tri UNION ALL SELECT c2, c0 FROM tri) GROUP BY 1, 2)"


@query(_TRI + _EDGES + " SELECT CAST(e0 AS BIGINT) AS e0, CAST(e1 AS BIGINT) AS e1, uses FROM e")
def edge_use_counts(spark, sf_dir):
    return mesh.edge_use(triangles(spark, sf_dir))


@query(_TRI + _EDGES + " SELECT CAST(e0 AS BIGINT) AS e0, CAST(e1 AS BIGINT) AS e1 FROM e WHERE uses = 1")
def boundary_edges(spark, sf_dir):
    return mesh.boundary_edges(triangles(spark, sf_dir))


# The least vertex that each one reaches; a vertex's row is replaced as long as a smaller label comes by.
_ROOTS = """, link AS (SELECT DISTINCT p, q FROM (SELECT c0 AS p, c1 AS q FROM tri UNION ALL SELECT c1, c0 FROM tri UNION ALL SELECT c0, c2 FROM tri UNION ALL SELECT c2, c0 FROM tri)),
lab(node, root) USING KEY (node) AS (SELECT p AS node, p AS root FROM link GROUP BY p UNION
 SELECT link.p, min(lab.root) FROM link JOIN lab ON lab.node = link.q JOIN recurring.lab AS cur ON cur.node = link.p WHERE lab.root < cur.root GROUP BY link.p)"""
_SIZES = ", sizes AS (SELECT l.root, count(*) AS n, sum(CAST(CAST(area AS FLOAT) AS DOUBLE)) AS total FROM tri JOIN lab l ON l.node = c0 GROUP BY l.root)"


@query(_TRI + _ROOTS + " SELECT CAST(node AS BIGINT) AS node, CAST(root AS BIGINT) AS root FROM lab")
def components_min_label(spark, sf_dir):
    return connected_components(mesh.vertex_links(triangles(spark, sf_dir)))


@query(_TRI + _ROOTS + _SIZES + " SELECT CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, CAST(c2 AS BIGINT) AS c2, round(area, 6) AS area FROM tri JOIN lab l ON l.node = c0 JOIN sizes USING (root) WHERE total >= 20 AND n >= 8")
def cull_islands(spark, sf_dir):
    found = triangles(spark, sf_dir).checkpoint()
    return mesh.cull_islands(found, connected_components(mesh.vertex_links(found)), 20.0, 8).withColumn("area", F.round("area", 6))


@query("""WITH t AS (SELECT [l_orderkey, l_partkey, l_suppkey] AS a, [l_partkey, l_suppkey, l_orderkey] AS b, [l_suppkey, l_orderkey, l_partkey] AS c FROM lineitem)
SELECT m[1] AS c0, m[2] AS c1, m[3] AS c2, count(*) AS n FROM (SELECT least(a, b, c) AS m FROM t) GROUP BY ALL""")
def canonical_triples(spark, sf_dir):
    a, b, c = mesh.canonical_triple(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"))
    return load(spark, sf_dir, "lineitem").select(a.alias("c0"), b.alias("c1"), c.alias("c2")).groupBy("c0", "c1", "c2").agg(F.count("*").alias("n"))


_RESIDUAL = "SELECT o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) AS v FROM orders"


@query(f"""SELECT count(*) AS n, round(sqrt(avg(v * v)), 4) AS rms, round(avg(abs(v)), 4) AS mean, round(quantile_cont(abs(v), 0.95), 4) AS p95, round(quantile_cont(abs(v), 0.999), 4) AS p99_9, round(max(abs(v)), 4) AS maximum,
round(avg(CAST(abs(v) <= 20000 AS INT)), 6) AS within_near, round(avg(CAST(abs(v) <= 50000 AS INT)), 6) AS within_far, round(avg(v), 4) + 0.0 AS mean_signed FROM ({_RESIDUAL})""")
def deviation_report(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select((F.col("o_totalprice") - F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))).alias("v"))
    found = reports.deviation(orders, "v", 20000, 50000)
    return found.select("n", *[F.round(c, 4).alias(c) for c in ("rms", "mean", "p95", "p99_9", "maximum")], *[F.round(c, 6).alias(c) for c in ("within_near", "within_far")], (F.round("mean_signed", 4) + 0.0).alias("mean_signed"))


@query(f"""WITH k AS (SELECT keep, event_type = 'error' AS mover FROM ({_despeckle_sql(_SCAN, True)}) JOIN events ON event_id = "row" * 100 + col)
SELECT count(*) FILTER (mover) AS movers, count(*) FILTER (mover AND NOT keep) AS caught, count(*) FILTER (NOT mover AND NOT keep) AS false_alarms, count(*) FILTER (mover AND keep) AS kept_movers, round(count(*) FILTER (mover AND NOT keep) / count(*) FILTER (mover), 9) AS recall, round(count(*) FILTER (NOT mover AND NOT keep) / count(*) FILTER (NOT mover), 9) AS false_positive FROM k""")
def mover_score(spark, sf_dir):
    judged = despeckle_wrap(spark, sf_dir).select((F.col("row").cast("long") * COLS + F.col("col")).alias("event_id"), "keep")
    truth = load(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("mover"))
    found = reports.mover_score(judged.join(truth, "event_id"))
    return found.withColumn("recall", F.round("recall", 9)).withColumn("false_positive", F.round("false_positive", 9))


@query("SELECT user_id, round(1 - sqrt(avg(cos(a)) ** 2 + avg(sin(a)) ** 2), 6) AS variance FROM (SELECT user_id, 2 * pi() * extract(hour FROM ts) / 24 AS a FROM events) GROUP BY user_id")
def circular_variance(spark, sf_dir):
    angles = load(spark, sf_dir, "events").select("user_id", (2 * math.pi * F.hour("ts") / 24).alias("a"))
    return reports.circular_variance(angles, "user_id", "a")


@query(f"SELECT r AS \"row\", c AS col, CAST((r // 16) * 7 + c // 16 AS BIGINT) AS tile_id FROM ({_SCAN})")
def tile_windows(spark, sf_dir):
    return tiling.with_tile(scan(spark, sf_dir).select("row", "col"), COLS, 16, 16)


@query(_TRI + """, o AS (SELECT c0, c1, c2, list_distinct([((v // 100) // 16) * 7 + (v % 100) // 16 FOR v IN [c0, c1, c2]]) AS s FROM tri), f AS (SELECT c0, c1, c2, list_min(s) AS owner, CAST(unnest(s) AS BIGINT) AS tile_id FROM o)
SELECT tile_id, count(*) AS triangle_count, count(*) FILTER (owner = tile_id) AS owned_count FROM f GROUP BY tile_id""")
def tile_manifest(spark, sf_dir):
    return tiling.manifest(triangles(spark, sf_dir), COLS, 16, 16)


@query(f"SELECT CAST(r * 100 + c AS BIGINT) AS cell, row_number() OVER (ORDER BY r, c) - 1 AS gid FROM ({_SPARSE})")
def dense_vertex_rank(spark, sf_dir):
    cells = scan(spark, sf_dir, True).select((F.col("row").cast("long") * COLS + F.col("col")).alias("cell"))
    return sampling.dense_rank(cells, "cell", "gid")


@query("""SELECT query_id, CAST(rank AS INT) AS rank, vec_id, distance FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(a.e, b.e), 6) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON a.vec_id <> b.vec_id) WHERE rank <= 2""")
def knn_exact_k2(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = sampling.nearest_exact(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 2)
    return found.withColumn("distance", F.round("distance", 6))


@query("""SELECT a.o_orderkey, min(abs(a.o_totalprice - b.o_totalprice)) AS nearest FROM orders a LEFT JOIN orders b ON b.o_custkey BETWEEN a.o_custkey - 8 AND a.o_custkey + 8 AND a.o_orderkey <> b.o_orderkey GROUP BY a.o_orderkey""")
def band_join_nearest(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sampling.band_nearest(orders, orders, "o_orderkey", "o_custkey", "o_totalprice", 8)


@query("""SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 'invalid scale' WHEN s_acctbal > 5000 THEN 'coarse scale' WHEN s_nationkey / s_acctbal * 100000 > 2147483647 / 1000000.0 THEN 'overflow' END AS finding FROM supplier
WHERE s_acctbal <= 0 OR s_acctbal > 5000 OR s_nationkey / s_acctbal * 100000 > 2147483647 / 1000000.0""")
def quantisation_findings(spark, sf_dir):
    axes = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("scale"), (F.col("s_nationkey") * 100000.0).alias("bound"))
    return reports.quantisation_findings(axes, "s_suppkey", most_scale=5000, most_raw=2147483647 / 1000000.0)
