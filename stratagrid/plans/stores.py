"""Registered queries of tile stores, output patches, observations, tiers and equivalence, over the surrogate mesh."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stratagrid.operators import equivalence, sampling, station
from stratagrid.plans.catalogue import _SPARSE, _TRI, COLS, query, scan, triangles
from stratagrid.plans.measures import _TILES
from stratagrid.plans.surfaces import _vertices
from stratagrid.sources import observations, tier, tilestore

WINDOWS = tilestore.Windows(COLS, 16, 16)


def _numbered(spark, sf_dir):
    """Triangles and the vertices that they use, ranked by cell."""
    faces = triangles(spark, sf_dir).select("c0", "c1", "c2").checkpoint()
    used = faces.select(F.explode(F.array("c0", "c1", "c2")).alias("cell")).distinct()
    ranked = sampling.dense_rank(used, "cell", "gid")
    return faces, ranked.join(_vertices(spark, sf_dir), "cell").withColumn("sample_id", F.col("cell") + 5_000_000_000)


def _store(spark, sf_dir) -> tilestore.TileStore:
    faces, vertices = _numbered(spark, sf_dir)
    root = tilestore.temporary(spark)
    tilestore.write(root, vertices, faces, WINDOWS)
    return tilestore.open_store(spark, root)


_WINDOW = "((({0} // 100) // 16) * 7 + ({0} % 100) // 16)"
_PLACED = _TILES + f""", ranked AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS gid FROM (SELECT DISTINCT unnest([c0, c1, c2]) AS cell FROM tri)),
held AS (SELECT DISTINCT m AS tile_id, unnest([c0, c1, c2]) AS cell FROM owned UNION SELECT {_WINDOW.format('cell')}, cell FROM ranked),
slots AS (SELECT tile_id, h.cell, gid, {_WINDOW.format('h.cell')} = tile_id AS mine FROM held h JOIN ranked USING (cell)),
num AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY mine DESC, gid) - 1 AS slot FROM slots)"""


@query(_PLACED + " SELECT CAST(tile_id AS BIGINT) AS tile_id, CAST(slot AS INT) AS slot, gid, mine AS owned FROM num")
def tile_assemble(spark, sf_dir):
    faces, vertices = _numbered(spark, sf_dir)
    return tilestore.placed_vertices(vertices, faces, WINDOWS)[0].select("tile_id", "slot", "gid", "owned")


@query(_PLACED + " SELECT CAST(m AS BIGINT) AS tile_id, CAST(x.slot AS INT) AS i0, CAST(y.slot AS INT) AS i1, CAST(z.slot AS INT) AS i2 FROM owned JOIN num x ON x.tile_id = m AND x.cell = c0 JOIN num y ON y.tile_id = m AND y.cell = c1 JOIN num z ON z.tile_id = m AND z.cell = c2")
def tile_triangles(spark, sf_dir):
    store = _store(spark, sf_dir)
    return store._table("triangles").select("tile_id", "i0", "i1", "i2")


@query(_PLACED + ", sh AS (SELECT gid FROM num GROUP BY gid HAVING count(*) > 1), f AS (SELECT m, count(*) AS n FROM owned GROUP BY m) SELECT CAST(tile_id AS BIGINT) AS tile_id, count(*) AS vertex_count, count(*) FILTER (mine) AS owned_count, CAST(coalesce(any_value(f.n), 0) AS BIGINT) AS triangle_count, count(sh.gid) AS boundary_count FROM num LEFT JOIN sh USING (gid) LEFT JOIN f ON f.m = tile_id GROUP BY tile_id")
def tile_store_manifest(spark, sf_dir):
    return _store(spark, sf_dir).manifest.drop("bounds")


@query(_PLACED + " SELECT gid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM ranked JOIN p USING (cell)")
def tile_reconstitute(spark, sf_dir):
    vertices, _ = _store(spark, sf_dir).mesh()
    return vertices.select("gid", *[F.round(c, 6).alias(c) for c in "xyz"])


_PATCH = "(({0} // 7) // 2) * 3 + ({0} % 7) // 3"


@query(_PLACED + f""", pn AS (SELECT {_PATCH.format('tile_id')} AS patch, gid, bool_or(mine) AS mine FROM num GROUP BY 1, 2), pf AS (SELECT {_PATCH.format('m')} AS patch, count(*) AS n FROM owned GROUP BY 1)
SELECT CAST(patch AS BIGINT) AS patch, count(*) AS vertices, count(*) FILTER (mine) AS owned, CAST(coalesce(any_value(pf.n), 0) AS BIGINT) AS triangles FROM pn LEFT JOIN pf USING (patch) GROUP BY patch""")
def output_patches(spark, sf_dir):
    vertices, faces = tilestore.window_patches(_store(spark, sf_dir), 2, 3)
    counted = faces.groupBy("patch").agg(F.count("*").alias("triangles"))
    return vertices.groupBy("patch").agg(F.count("*").alias("vertices"), F.count_if("owned").alias("owned")).join(counted, "patch", "left").select("patch", "vertices", "owned", F.coalesce("triangles", F.lit(0)).alias("triangles"))


@query(_PLACED + """, v AS (SELECT gid, cell, CAST(floor(x / 30) AS BIGINT) AS i, CAST(floor(y / 30) AS BIGINT) AS j FROM ranked JOIN p USING (cell)),
gt AS (SELECT v.i, v.j, c0, c1, c2 FROM tri JOIN v ON v.cell = least(c0, c1, c2)), gc AS (SELECT i, j, unnest([c0, c1, c2]) AS cell FROM gt), gh AS (SELECT DISTINCT gc.i, gc.j, v.gid FROM gc JOIN v USING (cell) UNION SELECT i, j, gid FROM v), gn AS (SELECT i, j, count(*) AS n FROM gt GROUP BY ALL)
SELECT gh.i AS i, gh.j AS j, count(*) AS vertices, count(*) FILTER (v.i = gh.i AND v.j = gh.j) AS owned, CAST(coalesce(any_value(gn.n), 0) AS BIGINT) AS triangles FROM gh JOIN v USING (gid) LEFT JOIN gn ON gn.i = gh.i AND gn.j = gh.j GROUP BY gh.i, gh.j""")
def ground_patches(spark, sf_dir):
    vertices, faces = tilestore.ground_patches(_store(spark, sf_dir), 30.0)
    counted = faces.groupBy("patch").agg(F.count("*").alias("triangles"))
    found = vertices.groupBy("patch").agg(F.count("*").alias("vertices"), F.count_if("owned").alias("owned")).join(counted, "patch", "left")
    return found.select("patch.i", "patch.j", "vertices", "owned", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def _observed(spark, sf_dir):
    own = scan(spark, sf_dir, True).select("*", (F.col("row").cast("long") * COLS + F.col("col")).alias("cell"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), (F.col("rng") / 100).alias("z"), F.lit("retained").alias("disposition"))
    return observations.observations(own, station.Lattice(1000, COLS, 0.0628, 0.01, -math.pi, -1.0), [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])


_OBSERVED = f"SELECT row_number() OVER (ORDER BY r, c) - 1 AS ordinal, sample_id, r, c, rng, CAST(c * 0.0628 - pi() AS FLOAT) AS azimuth, CAST(r * 0.01 - 1 AS FLOAT) AS elevation, -CAST(r AS DOUBLE) AS x, CAST(c AS DOUBLE) AS y FROM ({_SPARSE})"


@query(f"SELECT ordinal, sample_id, round(CAST(azimuth AS DOUBLE), 4) AS azimuth, round(CAST(elevation AS DOUBLE), 4) AS elevation, x + 0.0 AS x, y, CAST(1 AS INT) AS disposition FROM ({_OBSERVED})")
def observation_rows(spark, sf_dir):
    path = tilestore.temporary(spark)
    observations.write(_observed(spark, sf_dir), path)
    rows = observations.read(spark, path)
    return rows.select("ordinal", "sample_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("azimuth", "elevation")], (F.col("x").cast("double") + 0.0).alias("x"), F.col("y").cast("double").alias("y"), F.col("disposition").cast("int").alias("disposition"))


@query(f"SELECT r AS \"row\", min(ordinal) AS first, count(*) AS count FROM ({_OBSERVED}) GROUP BY r")
def observation_row_index(spark, sf_dir):
    return observations.row_index(_observed(spark, sf_dir))


@query(f"SELECT l_orderkey * 10 + l_linenumber AS request, ordinal, r AS \"row\", x + 0.0 AS x FROM lineitem JOIN ({_OBSERVED}) ON ordinal = l_partkey WHERE l_orderkey < 500")
def observation_gather(spark, sf_dir):
    from stratagrid.session import load

    wanted = load(spark, sf_dir, "lineitem").where("l_orderkey < 500").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request"), F.col("l_partkey").alias("ordinal"))
    return observations.gather(_observed(spark, sf_dir), wanted).select("request", "ordinal", "row", (F.col("x").cast("double") + 0.0).alias("x"))


def _encoded(spark, sf_dir, audience: int):
    faces, vertices = _numbered(spark, sf_dir)
    owned = faces.withColumn("tile_id", F.least(*[WINDOWS.of_cell(F.col(f"c{k}")) for k in range(3)])).withColumn("bound", F.lit(0.25))
    return tier.tiles(owned, vertices, tier.Tier(1, 3, 2.5, audience)), owned, vertices


_CORNERS = ", cor AS (SELECT m, unnest([c0, c1, c2]) AS v FROM owned)"


@query(_TILES + _CORNERS + " SELECT CAST(m AS BIGINT) AS tile_id, count(DISTINCT v) AS vertex_count, count(*) // 3 AS triangle_count, CAST(0 AS BIGINT) AS found, CAST(0 AS INT) AS audience, true AS balanced, 'position,triangle' AS arrays FROM cor GROUP BY m")
def tier_client_audit(spark, sf_dir):
    encoded, owned, vertices = _encoded(spark, sf_dir, tier.CLIENT)
    encoded = encoded.checkpoint()
    named = owned.select("tile_id", F.explode(F.array("c0", "c1", "c2")).alias("cell")).distinct().join(vertices.select("cell", "sample_id"), "cell")
    said = tier.described(encoded).select("tile_id", "audience", "balanced", "arrays")
    return encoded.select("tile_id", "vertex_count", "triangle_count").join(tier.audit(encoded, named), "tile_id").join(said, "tile_id")


@query(_TILES + _CORNERS + " SELECT DISTINCT CAST(m AS BIGINT) AS tile_id, CAST(v + 5000000000 AS BIGINT) AS sample_id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM cor JOIN p ON p.cell = v")
def tier_check_vertices(spark, sf_dir):
    encoded, _, _ = _encoded(spark, sf_dir, tier.CHECK)
    return tier.unpacked(encoded).select("tile_id", "sample_id", *[F.round(c, 5).alias(c) for c in "xyz"])


@query("SELECT unnest(['ledger-like', 'normals', 'triangles']) AS part, CAST(unnest([1, 0, 0]) AS BIGINT) AS differing")
def equivalence_checks(spark, sf_dir):
    faces = triangles(spark, sf_dir).select("c0", "c1", "c2").checkpoint()
    turned = faces.select(F.col("c1").alias("c0"), F.col("c2").alias("c1"), F.col("c0").alias("c2"))
    normals = _vertices(spark, sf_dir).select("cell", F.lit(0.0).alias("nx"), F.lit(0.6).alias("ny"), F.lit(0.8).alias("nz"))
    own = spark.range(5).select("id")
    checks = [equivalence.triangles("triangles", faces, turned), equivalence.normals("normals", normals, normals.withColumn("nz", F.col("nz") + 1e-9)), equivalence.rows("ledger-like", own, own.where("id < 4"))]
    return checks[0].unionByName(checks[1]).unionByName(checks[2]).select("part", "differing")


@query(_TRI + " SELECT count(*) AS triangles, count(*) FILTER (c0 > least(c1, c2)) AS turned FROM tri")
def oriented_triples(spark, sf_dir):
    return equivalence.oriented(triangles(spark, sf_dir)).agg(F.count("*").alias("triangles"), F.count_if("turned").alias("turned"))
