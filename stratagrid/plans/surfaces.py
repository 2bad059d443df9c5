"""Registered queries of meshes, lattices and frames, over the same surrogate views as the catalogue."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratagrid.functions import geometry
from stratagrid.operators import decimate, lattice, mesh, rangegrid, reports, sampling, stencil, surface, tiling
from stratagrid.operators.components import connected_components
from stratagrid.plans.catalogue import _CARVE, _EDGES, _GRID, _ROOTS, _SCAN, _SIZES, _SPARSE, _TRI, COLS, TOL_ABS, TOL_REL, _carved, _despeckle_sql, grid, points, query, scan, triangles
from stratagrid.session import load

#: A station's pose, for queries: a turn of 30 degrees about the vertical.
ROTATION = [[math.cos(math.pi / 6), -math.sin(math.pi / 6), 0.0], [math.sin(math.pi / 6), math.cos(math.pi / 6), 0.0], [0.0, 0.0, 1.0]]
SHIFT = [1000.125, -2000.25, 50.5]

_XYZ = "SELECT event_id, CAST(event_id % 100 - 50 AS DOUBLE) AS x, CAST(event_id // 100 % 90 - 45 AS DOUBLE) AS y, value / 10 - 20 AS z FROM events"
_C, _S = repr(ROTATION[0][0]), repr(ROTATION[1][0])


def _xyz(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_id") % 100 - 50).cast("double").alias("x"),
        (F.expr("event_id div 100") % 90 - 45).cast("double").alias("y"),
        (F.col("value") / 10 - 20).alias("z"),
    )


def _vector():
    return F.col("x"), F.col("y"), F.col("z")


def _vertices(spark, sf_dir):
    return points(spark, sf_dir).select((F.col("row").cast("long") * COLS + F.col("col")).alias("cell"), "x", "y", "z")


@query(f"SELECT event_id, CAST((least(greatest(CAST(trunc((atan2(y, x) + pi()) / (2 * pi()) * 360) AS BIGINT), -1), 360) + 360) % 360 AS BIGINT) AS u, least(greatest(CAST(trunc((asin(greatest(-1, least(1, z / sqrt(x*x+y*y+z*z)))) + pi() / 2) / pi() * 180) AS BIGINT), 0), 179) AS v FROM ({_XYZ})")
def spherical_bins(spark, sf_dir):
    u, v = rangegrid.direction_bin(*_vector(), 360, 180)
    return _xyz(spark, sf_dir).select("event_id", u.alias("u"), v.alias("v"))


@query(f"SELECT event_id, round(atan2(y, x), 6) AS azimuth, round(asin(greatest(-1, least(1, z / sqrt(x*x+y*y+z*z)))), 6) AS elevation, round(sqrt(x*x+y*y+z*z), 6) AS rng FROM ({_XYZ})")
def spherical_directions(spark, sf_dir):
    found = geometry.spherical(_vector())
    return _xyz(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(n) for c, n in zip(found, ("azimuth", "elevation", "rng"), strict=True)])


@query(f"SELECT event_id, round({_C} * x - {_S} * y + {SHIFT[0]}, 6) AS x, round({_S} * x + {_C} * y + {SHIFT[1]}, 6) AS y, round(z + {SHIFT[2]}, 6) AS z FROM ({_XYZ})")
def rigid_transform(spark, sf_dir):
    moved = geometry.to_world(_vector(), ROTATION, SHIFT)
    return _xyz(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(k) for c, k in zip(moved, "xyz", strict=True)])


@query(f"SELECT event_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM ({_XYZ})")
def rigid_roundtrip(spark, sf_dir):
    moved = _xyz(spark, sf_dir).select("event_id", *[c.alias(k) for c, k in zip(geometry.to_world(_vector(), ROTATION, SHIFT), "xyz", strict=True)])
    return moved.select("event_id", *[(F.round(c, 6) + 0.0).alias(k) for c, k in zip(geometry.to_local(_vector(), ROTATION, SHIFT), "xyz", strict=True)])


@query(f"""SELECT s.r AS "row", c AS col, rng, coalesce(g.r > rng + 0.4 AND g.r > 1.02 * rng, false) AS seen FROM ({_SCAN}) s LEFT JOIN ({_GRID}) g ON g.u = c AND g.v = s.r % 100""")
def seen_through(spark, sf_dir):
    samples = scan(spark, sf_dir).select("row", "col", "rng", (F.col("row") % 100).alias("v"), F.col("col").alias("u"))
    return rangegrid.seen_through(samples, grid(spark, sf_dir)).select("row", "col", "rng", "seen")


@query(f"""WITH s AS (SELECT "row", col, keep FROM ({_despeckle_sql(_SCAN, True)})), d AS (SELECT CASE WHEN value <= 1 THEN 'n' WHEN NOT keep THEN 'd' WHEN k.dropped THEN 'c' ELSE 'r' END AS d FROM events JOIN s ON event_id = s."row" * 100 + s.col JOIN ({_CARVE}) k ON event_id = k."row" * 100 + k.col)
SELECT count(*) AS input_points, count(*) FILTER (d = 'n') AS dropped_no_return, count(*) FILTER (d = 'd') AS dropped_despeckle, count(*) FILTER (d = 'c') AS dropped_mover_carve, CAST(0 AS BIGINT) AS dropped_other, CAST(0 AS BIGINT) AS dropped_island, count(*) FILTER (d = 'r') AS retained, true AS balanced FROM d""")
def clean_ledger(spark, sf_dir):
    kept = stencil.despeckle(scan(spark, sf_dir), COLS, True, TOL_ABS, TOL_REL).select("row", "col", "keep")
    judged = _carved(spark, sf_dir).join(kept, ["row", "col"])
    where = lattice.disposition(F.col("rng") > 1, F.col("keep"), F.col("dropped"), F.lit(True), F.lit(False))
    return lattice.ledger(judged.select(where.alias("disposition")))


@query(_TRI + ", f AS (SELECT CAST(CAST(area AS FLOAT) AS DOUBLE) AS a FROM tri) SELECT count(*) AS n, round(sum(a), 4) AS total, round(min(a) FILTER (a > 0), 6) AS least, round(max(a), 6) AS largest, sum(a) / min(a) FILTER (a > 0) < 536870912 AS exact FROM f")
def triangle_area_stats(spark, sf_dir):
    found = surface.area_stats(triangles(spark, sf_dir))
    return found.select("n", F.round("total", 4).alias("total"), F.round("least", 6).alias("least"), F.round("largest", 6).alias("largest"), "exact")


@query(_TRI + _EDGES + " SELECT CAST(e0 AS BIGINT) AS e0, CAST(e1 AS BIGINT) AS e1, uses FROM e WHERE uses > 2")
def nonmanifold_edges(spark, sf_dir):
    return mesh.nonmanifold_edges(triangles(spark, sf_dir))


_FACES = """, p2 AS (SELECT r * 100 + c AS cell, CAST(c AS DOUBLE) AS x, CAST(r AS DOUBLE) AS y, rng / 100 AS z FROM (SELECT r, c, rng FROM p)),
fx AS (SELECT t.c0, t.c1, t.c2, a.x, a.y, a.z, (b.y-a.y)*(o.z-a.z)-(b.z-a.z)*(o.y-a.y) AS nx, (b.z-a.z)*(o.x-a.x)-(b.x-a.x)*(o.z-a.z) AS ny, (b.x-a.x)*(o.y-a.y)-(b.y-a.y)*(o.x-a.x) AS nz FROM tri t JOIN p2 a ON a.cell = c0 JOIN p2 b ON b.cell = c1 JOIN p2 o ON o.cell = c2),
face AS (SELECT c0, c1, c2, x, y, z, sqrt(nx*nx+ny*ny+nz*nz) AS s, nx / s AS nx, ny / s AS ny, nz / s AS nz FROM fx WHERE nx*nx+ny*ny+nz*nz > 0)"""
_CORNER = "SELECT unnest([c0, c1, c2]) AS cell, * FROM face"


@query(_TRI + _FACES + f", v AS (SELECT cell, sum(s*nx) AS x, sum(s*ny) AS y, sum(s*nz) AS z FROM ({_CORNER}) GROUP BY cell) SELECT CAST(cell AS BIGINT) AS cell, round(x / sqrt(x*x+y*y+z*z), 6) + 0.0 AS nx, round(y / sqrt(x*x+y*y+z*z), 6) + 0.0 AS ny, round(z / sqrt(x*x+y*y+z*z), 6) + 0.0 AS nz FROM v")
def vertex_normals(spark, sf_dir):
    found = surface.vertex_normals(triangles(spark, sf_dir), _vertices(spark, sf_dir))
    return found.select("cell", *[(F.round(f"n{k}", 6) + 0.0).alias(f"n{k}") for k in "xyz"])


@query(_TRI + _FACES + f", v AS (SELECT cell, s, nx AS a, ny AS b, nz AS c, -(nx*x+ny*y+nz*z) AS d FROM ({_CORNER})) SELECT CAST(cell AS BIGINT) AS cell, {', '.join(f'round(sum(s/2*{k[0]}*{k[1]}), 4) + 0.0 AS {k}' for k in surface.QUADRIC)}, round(min(s) / 2, 6) AS min_face_area FROM v GROUP BY cell")
def plane_quadrics(spark, sf_dir):
    found = surface.plane_quadrics(triangles(spark, sf_dir), _vertices(spark, sf_dir))
    return found.select("cell", *[(F.round(k, 4) + 0.0).alias(k) for k in surface.QUADRIC], F.round("min_face_area", 6).alias("min_face_area"))


@query(_TRI + _FACES + """, e AS (SELECT least(p, q) AS e0, greatest(p, q) AS e1, nx, ny, nz FROM (SELECT c0 AS p, c1 AS q, nx, ny, nz FROM face UNION ALL SELECT c1, c2, nx, ny, nz FROM face UNION ALL SELECT c2, c0, nx, ny, nz FROM face)),
d AS (SELECT e0, e1, list({'x': nx, 'y': ny, 'z': nz}) AS n FROM e GROUP BY 1, 2 HAVING count(*) = 2),
g AS (SELECT degrees(atan2(sqrt((n[1].y*n[2].z-n[1].z*n[2].y)**2+(n[1].z*n[2].x-n[1].x*n[2].z)**2+(n[1].x*n[2].y-n[1].y*n[2].x)**2), n[1].x*n[2].x+n[1].y*n[2].y+n[1].z*n[2].z)) AS angle FROM d)
SELECT count(*) AS n, round(avg(angle), 6) AS mean, round(quantile_cont(angle, 0.5), 6) AS median, round(quantile_cont(angle, 0.99), 6) AS p99, round(max(angle), 6) AS maximum, count(*) FILTER (angle > 1) AS over_1, count(*) FILTER (angle > 5) AS over_5 FROM g""")
def dihedral_stats(spark, sf_dir):
    found = surface.dihedral_stats(surface.dihedrals(triangles(spark, sf_dir), _vertices(spark, sf_dir)))
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p99", "maximum")], "over_1", "over_5")


@query()
def decimate_patch(spark, sf_dir):
    found = tiling.placed_triangles(triangles(spark, sf_dir), COLS, 16, 16).where("owner = tile_id").select(F.col("owner").alias("patch"), "c0", "c1", "c2").checkpoint()
    done = decimate.decimate(found, _vertices(spark, sf_dir), decimate.Settings(max_plane_deviation=0.5))
    return done.groupBy("patch").agg(F.count("*").alias("triangles"), F.round(F.max("bound"), 6).alias("bound"))


@query(_TRI + _ROOTS + _SIZES + " SELECT CAST(root AS BIGINT) AS root, n AS triangles, round(total, 6) AS area FROM sizes")
def component_area(spark, sf_dir):
    found = triangles(spark, sf_dir).checkpoint()
    areas = mesh.component_areas(found, connected_components(mesh.vertex_links(found)))
    return areas.select("root", "triangles", F.round("area", 6).alias("area"))


@query(_TRI + _EDGES + """, b AS (SELECT e0, e1 FROM e WHERE uses = 1), e2 AS (SELECT least(p, q) AS e0, greatest(p, q) AS e1 FROM (SELECT c0 AS p, c1 AS q FROM tri WHERE area < 2 UNION ALL SELECT c1, c2 FROM tri WHERE area < 2 UNION ALL SELECT c2, c0 FROM tri WHERE area < 2) GROUP BY 1, 2 HAVING count(*) = 1)
SELECT CAST(e0 AS BIGINT) AS e0, CAST(e1 AS BIGINT) AS e1, side FROM (SELECT *, 'lost' AS side FROM (FROM b EXCEPT FROM e2) UNION ALL SELECT *, 'new' FROM (FROM e2 EXCEPT FROM b))""")
def seam_diff(spark, sf_dir):
    found = triangles(spark, sf_dir).checkpoint()
    return surface.seam_diff(mesh.boundary_edges(found), mesh.boundary_edges(found.where("area < 2")))


@query("""WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT l_partkey, l_suppkey, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus FROM a FULL JOIN b USING (l_partkey, l_suppkey) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def triple_multiset_diff(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return surface.multiset_diff(rows.where("l_returnflag = 'A'").drop("l_returnflag"), rows.where("l_returnflag = 'R'").drop("l_returnflag"))


@query("SELECT o_custkey, count(*) AS positions FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) GROUP BY 1 HAVING count(*) > 1")
def position_conflicts(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("x"), F.col("o_orderpriority").alias("y"), F.lit(0).alias("z"))
    return surface.position_conflicts(rows, "o_custkey")


@query(f"SELECT count(*) AS cells, max(n) AS largest, CAST(sum(n) AS BIGINT) AS total, avg(n) AS mean FROM (SELECT floor(x / 7) AS i, floor(y / 7) AS j, count(*) AS n FROM ({_XYZ}) GROUP BY 1, 2)")
def ground_occupancy(spark, sf_dir):
    return surface.ground_occupancy(_xyz(spark, sf_dir), 7.0)


@query("SELECT user_id, quantile_cont(gap, 0.5) AS step FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS gap FROM (SELECT DISTINCT user_id, value FROM events)) WHERE gap > 0 GROUP BY user_id")
def median_step(spark, sf_dir):
    return lattice.median_step(load(spark, sf_dir, "events"), "user_id", "value")


@query("SELECT event_type, count(*) AS n, round(regr_slope(value, event_id), 9) AS slope, round(regr_intercept(value, event_id), 4) AS intercept, round(regr_r2(value, event_id), 6) AS r2 FROM events GROUP BY event_type")
def linear_fit(spark, sf_dir):
    found = lattice.linear_fit(load(spark, sf_dir, "events"), "event_id", "value", ["event_type"])
    return found.select("event_type", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("SELECT p_partkey, concat_ws(';', 'p_brand=' || p_brand, 'p_size=' || p_size, 'p_type=' || p_type) AS evidence FROM part")
def evidence_pairs(spark, sf_dir):
    return lattice.evidence(load(spark, sf_dir, "part"), "p_partkey", ["p_type", "p_brand", "p_size"])


@query("SELECT w.band, count(*) AS samples FROM (SELECT event_id // 400 AS band FROM events) w GROUP BY 1")
def band_ownership(spark, sf_dir):
    return sampling.row_bands(scan(spark, sf_dir).select("row", "col", "rng"), 4, 3).where("core").groupBy("band").agg(F.count("*").alias("samples"))


@query(_TRI + ", o AS (SELECT c0, c1, c2, list_min([((v // 100) // 16) * 7 + (v % 100) // 16 FOR v IN [c0, c1, c2]]) AS m FROM tri) SELECT CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, CAST(c2 AS BIGINT) AS c2, CAST(m AS BIGINT) AS owner FROM o")
def tile_owner(spark, sf_dir):
    placed = tiling.placed_triangles(triangles(spark, sf_dir), COLS, 16, 16)
    return placed.where("owner = tile_id").select("c0", "c1", "c2", "owner")


@query(f"""SELECT count(*) AS n, count(DISTINCT r) AS keys, round(avg(v), 4) + 0.0 AS mean_signed, round(sqrt(avg(v * v)), 4) AS rms, count(*) FILTER (v < 0) AS behind, count(*) FILTER (v > 0) AS ahead, round(avg(CAST(v = 0 AS INT)), 6) AS zero_share,
round(avg(CAST(abs(v) <= 20 AS INT)), 6) AS within_bound, round(avg(CAST(abs(v) <= 60 AS INT)), 6) AS within_wide, CAST(1 AS DOUBLE) AS certified FROM (SELECT r, rng - avg(rng) OVER (PARTITION BY r) AS v FROM ({_SPARSE}))""")
def signed_deviation_report(spark, sf_dir):
    rows = scan(spark, sf_dir, True).select("row", (F.col("rng") - F.avg("rng").over(Window.partitionBy("row"))).alias("v"))
    found = reports.signed_deviation(rows, "v", "row", 20.0, 60.0)
    return found.select("n", "keys", (F.round("mean_signed", 4) + 0.0).alias("mean_signed"), F.round("rms", 4).alias("rms"), "behind", "ahead", *[F.round(c, 6).alias(c) for c in ("zero_share", "within_bound", "within_wide", "certified")])
