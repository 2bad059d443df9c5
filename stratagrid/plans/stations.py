"""Registered queries of whole stations, of points drawn on surfaces, and of frames and lattices."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stratagrid.operators import rangegrid, reverse, station, surface
from stratagrid.plans.catalogue import _GRID, _OFFSETS, _ROOTS, _SIZES, _SPARSE, _TRI, _TRI_OF, COLS, STEP, TOL_ABS, TOL_REL, grid, query, scan, triangles
from stratagrid.plans.surfaces import _vertices
from stratagrid.session import load
from stratagrid.sources import scans

RULES = station.Rules(tol_abs=TOL_ABS, tol_rel=TOL_REL, restore_support=2, noise_floor=1.0, min_component_area=20.0, min_component_triangles=8, band_rows=16)


def meshed(spark, sf_dir) -> station.Meshed:
    """The sparse lattice as a station between two others, whose grids are lineitem's."""
    own = grid(spark, sf_dir)
    samples = scan(spark, sf_dir, True).select("*", (F.col("row") % 100).alias("v"), F.col("col").alias("u"))
    voted = rangegrid.carve(samples, [own, own.select("u", (99 - F.col("v")).alias("v"), "r")])
    placed = voted.select("station_id", "row", "col", "sample_id", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), (F.col("rng") / 100).alias("z"), "rng", F.col("votes").cast("long").alias("votes"))
    events = load(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).first()
    lattice = station.Lattice(int(events["last"]) // COLS + 1, COLS, 2 * math.pi / COLS, STEP)
    return station.mesh_voted(placed, lattice, RULES, 2, source_sample_count=events["n"])


_STATION = f"""WITH RECURSIVE g AS ({_GRID}), s0 AS (SELECT s.r, s.c, s.rng, sample_id, CAST(coalesce(a.r > rng + 0.4 AND a.r > 1.02 * rng, false) AS INT) + CAST(coalesce(b.r > rng + 0.4 AND b.r > 1.02 * rng, false) AS INT) AS votes
 FROM ({_SPARSE}) s LEFT JOIN g a ON a.u = s.c AND a.v = s.r % 100 LEFT JOIN g b ON b.u = s.c AND 99 - b.v = s.r % 100),
d0 AS (SELECT s.r, s.c, count(n.rng) AS available, count(n.rng) FILTER (abs(n.rng - s.rng) <= {TOL_ABS} + {TOL_REL} * s.rng) AS support FROM s0 s CROSS JOIN {_OFFSETS} o LEFT JOIN s0 n ON n.r = s.r + o.dr AND n.c = (s.c + o.dc + 100) % 100 GROUP BY ALL),
kept AS (SELECT s0.* FROM s0 JOIN d0 USING (r, c) WHERE NOT (available >= 2 AND support < 2)),
back AS (SELECT s.r, s.c FROM kept s CROSS JOIN {_OFFSETS} o JOIN kept n ON n.r = s.r + o.dr AND n.c = (s.c + o.dc + 100) % 100 WHERE s.votes >= 2 AND n.votes < 2 AND abs(n.rng - s.rng) <= {TOL_ABS} + {TOL_REL} * s.rng GROUP BY ALL HAVING count(*) >= 2),
alive AS (SELECT kept.* FROM kept LEFT JOIN back b ON b.r = kept.r AND b.c = kept.c WHERE votes < 2 OR b.r IS NOT NULL), {_TRI_OF}""" + _ROOTS + _SIZES + """,
ends AS (SELECT s0.sample_id, CASE WHEN k.r IS NULL THEN 'dropped_despeckle' WHEN a.r IS NULL THEN 'dropped_mover_carve' WHEN l.node IS NULL THEN 'dropped_other' WHEN total >= 20 AND n >= 8 THEN 'retained' ELSE 'dropped_island' END AS disposition, s0.votes >= 2 AND a.r IS NOT NULL AS restored
 FROM s0 LEFT JOIN kept k ON k.r = s0.r AND k.c = s0.c LEFT JOIN alive a ON a.r = s0.r AND a.c = s0.c LEFT JOIN lab l ON l.node = s0.r * 100 + s0.c LEFT JOIN sizes z ON z.root = l.root)"""


@query(_STATION + """ SELECT (SELECT count(*) FROM events) AS input_points, (SELECT count(*) FROM events) - count(*) AS dropped_no_return, count(*) FILTER (disposition = 'dropped_despeckle') AS dropped_despeckle, count(*) FILTER (disposition = 'dropped_mover_carve') AS dropped_mover_carve,
count(*) FILTER (disposition = 'dropped_other') AS dropped_other, count(*) FILTER (disposition = 'dropped_island') AS dropped_island, count(*) FILTER (disposition = 'retained') AS retained, count(*) FILTER (restored) AS restored_from_carve, true AS balanced FROM ends""")
def station_ledger(spark, sf_dir):
    return meshed(spark, sf_dir).ledger.drop("station_id")


@query(_STATION + " SELECT sample_id, disposition, restored FROM ends")
def station_samples(spark, sf_dir):
    return meshed(spark, sf_dir).samples.select("sample_id", "disposition", "restored")


@query(_STATION + " SELECT CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, CAST(c2 AS BIGINT) AS c2, round(CAST(area AS FLOAT), 4) AS area, CAST(root AS BIGINT) AS component FROM tri JOIN lab l ON l.node = c0 JOIN sizes USING (root) WHERE total >= 20 AND n >= 8")
def station_triangles(spark, sf_dir):
    return meshed(spark, sf_dir).triangles.select("c0", "c1", "c2", F.round("area", 4).alias("area"), "component")


@query(_STATION + """, v AS (SELECT DISTINCT cell FROM (SELECT unnest([c0, c1, c2]) AS cell FROM tri JOIN lab l ON l.node = c0 JOIN sizes USING (root) WHERE total >= 20 AND n >= 8))
SELECT row_number() OVER (ORDER BY cell) - 1 AS gid, CAST(cell AS BIGINT) AS cell FROM v""")
def station_vertices(spark, sf_dir):
    return meshed(spark, sf_dir).vertices().select("gid", "cell")


# Points drawn on triangles.

_HEX = "regexp_replace(lpad(printf('%x', CAST({} AS BIGINT)), 16, '0'), '(..)(..)(..)(..)(..)(..)(..)(..)', '\\8\\7\\6\\5\\4\\3\\2\\1')"


def _unit_sql(digest: str, place: int) -> str:
    pairs = " || ".join(f"substr({digest}, {16 * place + 15 - 2 * k}, 2)" for k in range(8))
    return f"((CAST(('0x' || {pairs}) AS UBIGINT) + 0.5) / 18446744073709551616.0)"


_SHA = f"sha256(unhex('{reverse.DOMAIN.hex()}' || {' || '.join(_HEX.format(c) for c in ('7', 'l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber'))}))"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(1 - sqrt({_unit_sql('d', 0)}), 9) AS a, round(sqrt({_unit_sql('d', 0)}) * (1 - {_unit_sql('d', 1)}), 9) AS b, round(sqrt({_unit_sql('d', 0)}) * {_unit_sql('d', 1)}, 9) AS c FROM (SELECT *, {_SHA} AS d FROM lineitem)")
def sha_barycentric(spark, sf_dir):
    weights = reverse.interior([F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")], F.col("l_linenumber"), seed=7)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.round(w, 9).alias(n) for w, n in zip(weights, "abc", strict=True)])


def _surface(spark, sf_dir):
    found = surface.placed(triangles(spark, sf_dir), _vertices(spark, sf_dir))
    rows = [F.floor(F.col(f"c{k}") / COLS) for k in range(3)]
    return found.withColumn("low", F.least(*rows)).withColumn("high", F.greatest(*rows))


_CANON = _TRI + """, fl AS (SELECT CASE WHEN c0 <= least(c1, c2) THEN c0 WHEN c1 <= least(c0, c2) THEN c1 ELSE c2 END AS a, CASE WHEN c0 <= least(c1, c2) THEN c1 WHEN c1 <= least(c0, c2) THEN c2 ELSE c0 END AS b,
 CASE WHEN c0 <= least(c1, c2) THEN c2 WHEN c1 <= least(c0, c2) THEN c0 ELSE c1 END AS c, CAST(CAST(CAST(area AS FLOAT) AS DOUBLE) AS DECIMAL(28, 14)) AS w FROM tri WHERE area > 0),
run AS (SELECT *, sum(w) OVER (ORDER BY a, b, c ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER () AS total FROM fl), tg AS (SELECT unnest(range(500)) AS k),
sel AS (SELECT tg.k AS target, run.a, run.b, run.c FROM tg JOIN run ON (2 * tg.k + 1) * total >= 1000 * (cum - run.w) AND (2 * tg.k + 1) * total < 1000 * cum)"""


@query(_CANON + " SELECT target, CAST(a AS BIGINT) AS c0, CAST(b AS BIGINT) AS c1, CAST(c AS BIGINT) AS c2 FROM sel")
def reverse_selection(spark, sf_dir):
    return reverse.selected(_surface(spark, sf_dir).checkpoint(), 500).select("target", "c0", "c1", "c2")


_DRAWN = f"""sha256(unhex('{reverse.DOMAIN.hex()}' || {' || '.join(_HEX.format(x) for x in ('0', 'a', 'b', 'c', 'target'))}))"""


@query(_CANON + f""", dg AS (SELECT *, {_DRAWN} AS d FROM sel), wt AS (SELECT target, a, b, c, 1 - sqrt({_unit_sql('d', 0)}) AS wa, sqrt({_unit_sql('d', 0)}) * (1 - {_unit_sql('d', 1)}) AS wb, sqrt({_unit_sql('d', 0)}) * {_unit_sql('d', 1)} AS wc FROM dg),
pt AS (SELECT target, wa*x.x+wb*y.x+wc*z.x AS px, wa*x.y+wb*y.y+wc*z.y AS py, wa*x.z+wb*y.z+wc*z.z AS pz, least(x.r, y.r, z.r) - 8 AS low, greatest(x.r, y.r, z.r) + 8 AS high FROM wt JOIN p x ON x.cell = wt.a JOIN p y ON y.cell = wt.b JOIN p z ON z.cell = wt.c)
SELECT target, round(sqrt(min((px-x)*(px-x)+(py-y)*(py-y)+(pz-z)*(pz-z))), 6) AS distance FROM pt LEFT JOIN p ON p.r BETWEEN low AND high GROUP BY target""")
def reverse_distances(spark, sf_dir):
    own = _vertices(spark, sf_dir).withColumn("row", F.floor(F.col("cell") / COLS))
    found = reverse.reverse_report(_surface(spark, sf_dir).checkpoint(), own, most=500)
    return found.distances.withColumn("distance", F.round("distance", 6))


# Frames and lattices.

_TURN = "2 * pi() / 150"


@query(f"""WITH t AS (SELECT user_id % 7 AS station_id, event_id % 60 AS col, value AS a FROM events), m AS (SELECT station_id, col, count(*) AS n, 1 - sqrt(avg(sin(a)) ** 2 + avg(cos(a)) ** 2) AS v FROM t GROUP BY ALL)
SELECT station_id, round(coalesce(avg(v) FILTER (n >= 8), 1.0), 6) AS spread FROM m GROUP BY station_id""")
def column_alignment(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("station_id"), (F.col("event_id") % 60).alias("col"), "value")
    return scans.column_spread(rows, F.col("value"), "spread").select("station_id", F.round("spread", 6).alias("spread"))


@query(f"""WITH e AS (SELECT s_suppkey AS station_id, s_suppkey % 11 = 0 AS has_spherical, s_suppkey % 7 <> 0 AS has_row_column, s_suppkey % 5 <> 0 AS posed, s_nationkey * 20 AS samples, abs(s_acctbal) / 1e6 AS as_local, s_suppkey / 1e4 AS as_world, abs(s_acctbal) * 2 AS max_local, s_suppkey * 150.0 AS max_world, {_TURN} AS az_step FROM supplier),
c AS (SELECT *, greatest(pow({scans.ALIGNED_STEPS} * abs(az_step), 2) / 2, {scans.ALIGNED_FLOOR}) AS top, max_local <= 10000 AS l, max_world <= 10000 AS w FROM e)
SELECT station_id, CASE WHEN has_spherical THEN 'spherical' WHEN NOT has_row_column THEN 'no_row_column' WHEN NOT posed THEN 'identity_pose' WHEN samples < 64 THEN 'too_few_samples' WHEN NOT l AND NOT w THEN 'implausible' WHEN l AND NOT w THEN 'left_as_local' WHEN w AND NOT l THEN 'rewritten_to_local'
WHEN as_world <= top AND as_world < as_local * 0.2 THEN 'rewritten_to_local' WHEN as_local <= top THEN 'left_as_local' ELSE 'undecided' END AS path FROM c""")
def frame_paths(spark, sf_dir):
    key, bal = F.col("s_suppkey"), F.abs("s_acctbal")
    evidence = load(spark, sf_dir, "supplier").select(
        key.alias("station_id"), (key % 11 == 0).alias("has_spherical"), (key % 7 != 0).alias("has_row_column"), (key % 5 != 0).alias("posed"), (F.col("s_nationkey") * 20).alias("samples"),
        (bal / 1e6).alias("as_local"), (key / 1e4).alias("as_world"), (bal * 2).alias("max_local"), (key * 150.0).alias("max_world"), F.lit(2 * math.pi / 150).alias("az_step"),
    )
    return scans.decide_frame(evidence).select("station_id", "path")


@query("""WITH t AS (SELECT user_id % 5 AS station_id, CAST(event_id // 100 AS INT) AS "row", CAST(event_id % 100 AS INT) AS col, (event_id % 100) * 0.0628 - 3.1 + value / 1e6 AS az, (event_id // 100) * 0.01 - 1 + value / 1e7 AS el FROM events WHERE event_type <> 'error'),
z AS (SELECT station_id, max("row") + 1 AS nrows, max(col) + 1 AS ncols FROM t GROUP BY 1),
q AS (SELECT station_id, az - lag(az) OVER w AS d, col - lag(col) OVER w AS gap FROM t WINDOW w AS (PARTITION BY station_id, "row" ORDER BY col)),
s AS (SELECT station_id, quantile_cont(atan2(sin(d), cos(d)) / gap, 0.5) AS az_step FROM q JOIN z USING (station_id) WHERE gap > 0 AND gap < ncols // 2 GROUP BY 1),
l AS (SELECT station_id, regr_slope(el, "row") AS el_step, regr_intercept(el, "row") AS el0 FROM t GROUP BY 1),
f AS (SELECT station_id, atan2(avg(sin(az - col * az_step)), avg(cos(az - col * az_step))) AS az0 FROM t JOIN s USING (station_id) GROUP BY 1)
SELECT station_id, nrows AS n_rows, ncols AS n_cols, round(az_step, 9) AS az_step, round(el_step, 9) AS el_step, round(az0, 6) AS az0, round(el0, 6) AS el0 FROM z JOIN s USING (station_id) JOIN l USING (station_id) JOIN f USING (station_id)""")
def lattice_steps(spark, sf_dir):
    row, col, noise = F.expr("event_id div 100"), F.col("event_id") % 100, F.col("value")
    rows = load(spark, sf_dir, "events").where("event_type <> 'error'").select(
        (F.col("user_id") % 5).alias("station_id"), F.col("event_id").alias("sample_id"), row.cast("int").alias("row"), col.cast("int").alias("col"), (col * 0.0628 - 3.1 + noise / 1e6).alias("az"), (row * 0.01 - 1 + noise / 1e7).alias("el"),
    )
    found = scans.lattice_of_indices(rows)
    return found.select("station_id", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"), *[F.round(c, 9).alias(c) for c in ("az_step", "el_step")], *[F.round(c, 6).alias(c) for c in ("az0", "el0")])
