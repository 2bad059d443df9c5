"""A synthetic room as a scan: rays of a lattice, cast by column expressions.

The room is a box seen from inside, with a doorway, a thin rail, a column, and
a box that moves while the scanner turns. Every ray is one row, its hit a
closed form of its direction, so the scan is made where its rows are, in the
JVM. Noise and dropouts are hashes of the seed and the ray's number: a ray has
the same values however rays are partitioned, and again when a task is rerun.

room_scan gives the rays that came back, with the truth beside each: the
distance to what stands still, what was hit, and whether that was the mover.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a ray can hit; the numbers of column surface. Fixed values.
SURFACES = ("none", "room", "beyond_door", "column", "rail", "mover")
#: A flat colour for each of them. Fixed values of our own.
COLOURS = ((0, 0, 0), (200, 196, 188), (150, 170, 190), (180, 120, 90), (90, 90, 100), (220, 60, 60))


@dataclass(frozen=True)
class Room:
    """Lengths in metres; a moving box goes from one place to the other during the sweep. Fixed values."""

    half_x: float = 4.0
    half_y: float = 3.0
    floor_z: float = -1.6
    ceil_z: float = 1.4
    scanner: tuple[float, float, float] = (0.35, -0.2, 0.0)
    door_half_width: float = 0.45
    door_bottom: float = -1.6
    door_top: float = 0.45
    door_depth: float = 4.0
    rail_centre: tuple[float, float] = (-2.4, 1.9)
    rail_radius: float = 0.03
    column_centre: tuple[float, float] = (1.6, 1.4)
    column_radius: float = 0.15
    mover: bool = True
    mover_half: tuple[float, float, float] = (0.25, 0.2, 0.85)
    mover_from: tuple[float, float] = (-2.0, -2.2)
    mover_to: tuple[float, float] = (2.2, -1.4)
    mover_z: float = -0.7

    def scaled(self, factor: float) -> Room:
        """A similar room, all lengths and the scanner's place times the factor."""
        if not (math.isfinite(factor) and factor > 0):
            raise ValueError(f"a scale must be a positive number, not {factor!r}")

        def times(x):
            return tuple(v * factor for v in x) if isinstance(x, tuple) else x if isinstance(x, bool) else x * factor

        return replace(self, **{f.name: times(getattr(self, f.name)) for f in fields(self)})


def _uniform(seed: int, salt: str) -> Column:
    """In (0, 1), from the ray's number."""
    return (F.pmod(F.xxhash64("ray", F.lit(seed), F.lit(salt)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def _box_exit(o, d, low, high) -> tuple[Column, Column]:
    """Where a ray from inside a box leaves it, and whether that is by the side of greater x."""
    reach = [F.when(v > 0, (F.lit(hi) - F.lit(x)) / v).when(v < 0, (F.lit(lo) - F.lit(x)) / v).otherwise(F.lit(math.inf)) for x, v, lo, hi in zip(o, d, low, high, strict=True)]
    t = F.least(*reach)
    return t, (reach[0] == t) & (d[0] > 0)


def _cylinder(o, d, centre, radius: float, low: float, high: float) -> Column:
    """Nearest hit of an upright cylinder between two heights, infinite for a miss."""
    ox, oy = o[0] - centre[0], o[1] - centre[1]
    a = d[0] * d[0] + d[1] * d[1]
    half = d[0] * ox + d[1] * oy
    gap = half * half - a * (ox * ox + oy * oy - radius * radius)
    root = F.sqrt(F.greatest(gap, F.lit(0.0)))

    def at(t):
        z = d[2] * t + o[2]
        return F.when((gap > 0) & (a > 1e-12) & (t > 1e-6) & (z >= low) & (z <= high), t).otherwise(F.lit(math.inf))

    return F.least(at((-half - root) / a), at((-half + root) / a))


def _moving_box(o, d, room: Room, sweep: Column) -> Column:
    """Nearest hit of the mover, whose centre depends on how far the sweep is."""
    centre = [F.lit(a) + (b - a) * sweep for a, b in zip(room.mover_from, room.mover_to, strict=True)] + [F.lit(room.mover_z)]
    near, far = [], []
    for x, v, c, half in zip(o, d, centre, room.mover_half, strict=True):
        p, q = (c - half - x) / v, (c + half - x) / v
        inside = F.abs(c - x) <= half
        flat = F.abs(v) < 1e-12
        near.append(F.when(flat, F.when(inside, F.lit(-math.inf)).otherwise(F.lit(math.inf))).otherwise(F.least(p, q)))
        far.append(F.when(flat, F.when(inside, F.lit(math.inf)).otherwise(F.lit(-math.inf))).otherwise(F.greatest(p, q)))
    first, last = F.greatest(*near), F.least(*far)
    t = F.when(first > 1e-6, first).otherwise(last)
    return F.when((last >= first) & (t > 1e-6), t).otherwise(F.lit(math.inf))


def rays(spark: SparkSession, rows: int, cols: int, low_deg: float = -60.0, high_deg: float = 60.0, partitions: int | None = None) -> DataFrame:
    """Columns ray, row, col, dx, dy, dz: the directions of a full sweep."""
    step = math.radians(high_deg - low_deg) / max(rows - 1, 1)
    table = spark.range(0, rows * cols, 1, partitions or spark.sparkContext.defaultParallelism).withColumnRenamed("id", "ray")
    placed = table.select("ray", F.expr(f"cast(ray div {cols} as int)").alias("row"), (F.col("ray") % cols).cast("int").alias("col"))
    azimuth, elevation = F.col("col") * (2 * math.pi / cols) - math.pi, F.col("row") * step + math.radians(low_deg)
    turned = placed.select("ray", "row", "col", F.cos(azimuth).alias("ca"), F.sin(azimuth).alias("sa"), F.cos(elevation).alias("ce"), F.sin(elevation).alias("dz"))
    return turned.select("ray", "row", "col", (F.col("ce") * F.col("ca")).alias("dx"), (F.col("ce") * F.col("sa")).alias("dy"), "dz")


def _once(table: DataFrame, **columns: Column) -> DataFrame:
    """table with more columns, each of which is computed once however often later ones name it.

    Catalyst puts a column's expression in the place of its name, also where a
    filter is moved down; what a generator gives it leaves alone.
    """
    own = F.struct(*table.columns, *[c.alias(n) for n, c in columns.items()])
    return table.select(F.explode(F.array(own)).alias("_row")).select("_row.*")


def room_scan(spark: SparkSession, room: Room | None = None, rows: int = 900, cols: int = 3600, noise: float = 0.002, dropout: float = 0.01, seed: int = 7, station_id: str = "synthetic", low_deg: float = -60.0, high_deg: float = 60.0) -> DataFrame:
    """Columns station_id, row, col, x, y, z, rng, r, g, b, sample_id, and the truth: true_range, surface, is_mover, dx, dy, dz.

    Coordinates are the scanner's own. Rays without a return (dropouts, and hits
    nearer than 0.3 m) are not rows; rows * cols less the count is their number.
    """
    room = room or Room()
    cast = rays(spark, rows, cols, low_deg, high_deg)
    o, d = room.scanner, (F.col("dx"), F.col("dy"), F.col("dz"))
    leave, by_door_side = _box_exit(o, d, (-room.half_x, -room.half_y, room.floor_z), (room.half_x, room.half_y, room.ceil_z))
    cast = _once(cast, leave=leave, side=by_door_side)
    y, z = d[1] * F.col("leave") + o[1], d[2] * F.col("leave") + o[2]
    through = F.col("side") & (F.abs(y) <= room.door_half_width) & (z >= room.door_bottom) & (z <= room.door_top)
    cast = _once(cast, through=through)
    hits = {
        "room": F.when(~F.col("through"), F.col("leave")).otherwise(F.lit(math.inf)),
        "beyond_door": F.when(F.col("through"), (room.half_x + room.door_depth - o[0]) / d[0]).otherwise(F.lit(math.inf)),
        "column": _cylinder(o, d, room.column_centre, room.column_radius, room.floor_z, room.ceil_z),
        "rail": _cylinder(o, d, room.rail_centre, room.rail_radius, room.floor_z, room.ceil_z),
        "mover": _moving_box(o, d, room, F.col("col") / float(max(cols - 1, 1))) if room.mover else F.lit(math.inf),
    }
    cast = _once(cast, **hits).drop("leave", "side", "through")
    still = F.least("room", "beyond_door", "column", "rail")
    cast = _once(cast, true_range=still)
    cast = cast.withColumn("is_mover", F.col("mover") < F.col("true_range")).withColumn("hit", F.least("mover", "true_range"))
    surface = reduce(lambda out, n: F.when(F.col(n) == F.col("true_range"), SURFACES.index(n)).otherwise(out), ("room", "beyond_door", "rail", "column"), F.lit(0))
    cast = cast.withColumn("surface", F.when(F.col("is_mover"), SURFACES.index("mover")).otherwise(surface))
    back = (F.col("hit") > 0.3) & (F.col("hit") < math.inf)
    if dropout > 0:
        back &= _uniform(seed, "dropout") >= dropout
    error = F.sqrt(-2 * F.log(_uniform(seed, "radius"))) * F.cos(2 * math.pi * _uniform(seed, "angle")) * noise
    seen = _once(cast.where(back), measured=F.col("hit") + error)
    colour = [F.element_at(F.array(*[F.lit(c[k]).cast("short") for c in COLOURS]), F.col("surface") + 1).alias(n) for k, n in enumerate("rgb")]
    place = [(F.col(f"d{k}") * F.col("measured")).cast("float").alias(k) for k in "xyz"]
    return seen.select(F.lit(station_id).alias("station_id"), "row", "col", *place, F.col("measured").cast("float").alias("rng"), *colour, F.col("ray").alias("sample_id"), "true_range", "surface", "is_mover", "dx", "dy", "dz")


def station_row(spark: SparkSession, room: Room, rows: int, cols: int, station_id: str) -> DataFrame:
    """The station's row of metadata: lattice, place, and how many rays were cast."""
    fields_ = "station_id string, rows int, cols int, az_step double, el_step double, az0 double, el0 double, t array<double>, rot array<array<double>>, source_sample_count long"
    el_step = math.radians(120.0) / max(rows - 1, 1)
    identity = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    return spark.createDataFrame([(station_id, rows, cols, 2 * math.pi / cols, el_step, -math.pi, math.radians(-60.0), list(map(float, room.scanner)), identity, rows * cols)], fields_)
