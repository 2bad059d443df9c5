"""Registered queries of distances to meshes and of containers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import qa, tiling
from stratagrid.plans.catalogue import _SCAN, _TRI, COLS, query, scan, triangles
from stratagrid.plans.surfaces import _vertices
from stratagrid.sources import glb

def _square(u: str, v: str) -> str:
    """SQL of the squared distance of q to the segment from u to v."""
    along = " + ".join(f"({v}[{i}]-{u}[{i}])*({v}[{i}]-{u}[{i}])" for i in (1, 2, 3))
    t = f"greatest(0, least(1, ({' + '.join(f'(q[{i}]-{u}[{i}])*({v}[{i}]-{u}[{i}])' for i in (1, 2, 3))}) / ({along})))"
    return " + ".join(f"pow(q[{i}]-{u}[{i}]-{t}*({v}[{i}]-{u}[{i}]), 2)" for i in (1, 2, 3))


def _side(u: str, v: str) -> str:
    """SQL of which side of the edge from u to v q is on, seen along n."""
    return " + ".join(f"n[{i}]*(({v}[{j}]-{u}[{j}])*(q[{k}]-{u}[{k}])-({v}[{k}]-{u}[{k}])*(q[{j}]-{u}[{j}]))" for i, j, k in ((1, 2, 3), (2, 3, 1), (3, 1, 2)))


_NORMAL = "[" + ", ".join(f"(b[{j}]-a[{j}])*(c[{k}]-a[{k}])-(b[{k}]-a[{k}])*(c[{j}]-a[{j}])" for j, k in ((2, 3), (3, 1), (1, 2))) + "]"

# A lattice cell has a vertex at most 6 away in x and y, so the join misses none of the two nearest.
_FORWARD = _TRI + f""", pv AS (SELECT r, c, r * 100 + c AS cell, [CAST(c AS DOUBLE), CAST(r AS DOUBLE), rng / 100] AS v FROM p), smp AS (SELECT sample_id, r, c, [c + 0.3, r + 0.2, rng / 100] AS q FROM ({_SCAN})),
nearest AS (SELECT sample_id, q, cell, list_distance(q, v) AS d FROM smp JOIN pv ON pv.r BETWEEN smp.r - 7 AND smp.r + 7 AND pv.c BETWEEN smp.c - 7 AND smp.c + 7 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d, cell) <= 2),
fac AS (SELECT x.v AS a, y.v AS b, z.v AS c, unnest([c0, c1, c2]) AS cell FROM tri JOIN pv x ON x.cell = c0 JOIN pv y ON y.cell = c1 JOIN pv z ON z.cell = c2),
met AS (SELECT sample_id, d, q, a, b, c, {_NORMAL} AS n FROM nearest LEFT JOIN fac USING (cell)),
reached AS (SELECT sample_id, d, CASE WHEN a IS NULL THEN NULL WHEN {_side('a', 'b')} >= 0 AND {_side('b', 'c')} >= 0 AND {_side('c', 'a')} >= 0 AND n[1]*n[1]+n[2]*n[2]+n[3]*n[3] > 0 THEN abs((q[1]-a[1])*n[1]+(q[2]-a[2])*n[2]+(q[3]-a[3])*n[3]) / sqrt(n[1]*n[1]+n[2]*n[2]+n[3]*n[3]) ELSE sqrt(least({_square('a', 'b')}, {_square('b', 'c')}, {_square('c', 'a')})) END AS t FROM met)
SELECT sample_id, round(coalesce(min(t), min(d)), 6) AS distance FROM reached GROUP BY sample_id"""


@query(_FORWARD)
def forward_distances(spark, sf_dir):
    samples = scan(spark, sf_dir).select("sample_id", (F.col("col") + 0.3).alias("x"), (F.col("row") + 0.2).alias("y"), (F.col("rng") / 100).alias("z"))
    found = qa.forward_distances(samples, triangles(spark, sf_dir), _vertices(spark, sf_dir))
    return found.select("sample_id", F.round("distance", 6).alias("distance"))


_TILES = _TRI + ", owned AS (SELECT c0, c1, c2, list_min([((v // 100) // 16) * 7 + (v % 100) // 16 FOR v IN [c0, c1, c2]]) AS m FROM tri)"


@query(_TILES + ", cor AS (SELECT m, unnest([c0, c1, c2]) AS v FROM owned) SELECT CAST(m AS BIGINT) AS tile_id, count(DISTINCT v) AS vertex_count, count(*) // 3 AS triangle_count, true AS balanced FROM cor GROUP BY m")
def glb_audit(spark, sf_dir):
    placed = tiling.placed_triangles(triangles(spark, sf_dir), COLS, 16, 16).where("owner = tile_id")
    return glb.audit(glb.glb_tiles(placed, _vertices(spark, sf_dir))).select("tile_id", "vertex_count", "triangle_count", "balanced")


@query(_TILES + ", cor AS (SELECT DISTINCT m AS tile_id, v AS cell FROM (SELECT m, unnest([c0, c1, c2]) AS v FROM owned)) SELECT CAST(tile_id AS BIGINT) AS tile_id, CAST(cell AS BIGINT) AS cell FROM cor WHERE tile_id <> ((cell // 100) // 16) * 7 + (cell % 100) // 16")
def tile_halo(spark, sf_dir):
    placed = tiling.placed_triangles(triangles(spark, sf_dir), COLS, 16, 16).where("owner = tile_id")
    return tiling.halo(placed, COLS, 16, 16)
