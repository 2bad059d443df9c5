"""Station scans with the fields of structured point files, as tables: from raw rows to samples on a lattice.

A raw table has station_id, sample_id (the row's place in its source) and the
fields that its source had, by the names that such files use. What a field is
good for follows from which fields there are, the same for all rows. All
stations of a table are handled at once; what is decided for a station comes
from aggregations over its rows and is joined back, one row a station.

Lattice indices come from row and column numbers, else from angles of the
file, else from angles of the positions, which halves the resolution as such
angles are rounded. Frames: positions that are not in the scanner's own frame
although they should be are turned into it, if the evidence is decisive; see
decide_frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.functions import geometry
from stratagrid.session import shared_folder

#: Names of fields in structured point files. Fixed values.
CARTESIAN = ("cartesianX", "cartesianY", "cartesianZ")
SPHERICAL = ("sphericalRange", "sphericalAzimuth", "sphericalElevation")
ROW_COLUMN = ("rowIndex", "columnIndex")
COLOUR = ("colorRed", "colorGreen", "colorBlue")
STATES = ("cartesianInvalidState", "sphericalInvalidState")
OTHER_FIELDS = ("intensity",)
#: Where rows and columns come from.
TIERS = ("row_column", "spherical", "projected")

#: Limits of a frame's evidence. Fixed values.
LEAST_RANGE, MOST_RANGE = 0.3, 10_000.0
ALIGNED_STEPS, ALIGNED_FLOOR, DECISIVE, LEAST_SAMPLES, LEAST_IN_COLUMN = 4.0, 1e-12, 0.2, 64, 8
#: Rows of a station that estimates look at, about.
ESTIMATE_ROWS, FRAME_ROWS = 200_000, 100_000


def tier_of(fields: list[str]) -> str:
    """Which of TIERS a table with these fields is."""
    if set(ROW_COLUMN) <= set(fields):
        return TIERS[0]
    return TIERS[1] if set(SPHERICAL[1:]) <= set(fields) else TIERS[2]


def check_fields(raw: DataFrame, wanted: list[str]) -> DataFrame:
    """raw's wanted fields; no field, a field that no scan has, or one that this table lacks raises."""
    known = {*CARTESIAN, *SPHERICAL, *ROW_COLUMN, *COLOUR, *STATES, *OTHER_FIELDS}
    if not wanted:
        raise ValueError("no field is asked for")
    if unknown := set(wanted) - known:
        raise ValueError(f"not fields of scans: {sorted(unknown)}")
    if missing := set(wanted) - set(raw.columns):
        raise ValueError(f"not in this table: {sorted(missing)}")
    return raw.select("station_id", "sample_id", *wanted)


def probe(raw: DataFrame) -> DataFrame:
    """One row a station: its tier, fields and number of rows."""
    fields = sorted(set(raw.columns) - {"station_id", "sample_id"})
    return raw.groupBy("station_id").agg(F.count("*").alias("points")).withColumn("tier", F.lit(tier_of(fields))).withColumn("fields", F.array(*[F.lit(f) for f in fields]))


def positions(fields: list[str]) -> tuple[geometry.Vector, Column]:
    """Columns of place and range, from spherical fields if there are, else from cartesian ones."""
    if set(SPHERICAL) <= set(fields):
        rng, azimuth, elevation = (F.col(f).cast("double") for f in SPHERICAL)
        return geometry.cartesian(azimuth, elevation, rng), rng
    if set(CARTESIAN) <= set(fields):
        own = tuple(F.col(f).cast("double") for f in CARTESIAN)
        return own, geometry.norm(own)
    raise ValueError("a scan has spherical or cartesian fields")


def valid(fields: list[str], rng: Column) -> Column:
    """Whether a row is a return: a finite range beyond the scanner itself, and no flag against it."""
    ok = F.coalesce((rng > LEAST_RANGE) & (rng < math.inf) & ~F.isnan(rng), F.lit(False))
    for flag in STATES:
        if flag in fields:
            ok &= F.coalesce(F.col(flag), F.lit(0)) == 0
    return ok


def colour(raw: DataFrame) -> DataFrame:
    """raw with r, g, b in 0 to 255; a station with larger whole numbers in a channel has them shifted by a byte. None without colour fields."""
    if not set(COLOUR) <= set(raw.columns):
        return raw
    whole = [f for f in COLOUR if raw.schema[f].dataType.typeName() in ("byte", "short", "integer", "long")]
    deep = raw.groupBy("station_id").agg(*[F.coalesce(F.max(f) > 255, F.lit(False)).alias(f"_{f}") for f in whole]) if whole else None
    out = raw.join(F.broadcast(deep), "station_id") if deep is not None else raw
    for f, name in zip(COLOUR, "rgb", strict=True):
        value = F.when(F.col(f"_{f}"), F.floor(F.col(f) / 256)).otherwise(F.col(f)) if f in whole else F.col(f)
        out = out.withColumn(name, F.least(F.greatest(value, F.lit(0)), F.lit(255)).cast("short"))
    return out.drop(*[f"_{f}" for f in whole])


def intensity(raw: DataFrame) -> Column:
    """Sixteen bits: fractions are scaled, whole numbers cut to the range."""
    value = F.col("intensity")
    if raw.schema["intensity"].dataType.typeName() in ("float", "double"):
        value = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 65535.0
    return F.least(F.greatest(value, F.lit(0)), F.lit(65535)).cast("int")


def rotation_of(quaternion: tuple[float, float, float, float]) -> list[list[float]]:
    """The rotation of a quaternion w, x, y, z of any length but zero."""
    size = math.sqrt(sum(v * v for v in quaternion))
    if not size > 0:
        raise ValueError("a rotation needs a quaternion that is not zero")
    w, x, y, z = (v / size for v in quaternion)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def pose_of(header: dict) -> tuple[list[float], list[list[float]]]:
    """Place and rotation of a header: a 3 by 3 matrix, a quaternion, or nothing, under the names in use; checked to be a rotation."""
    place = next((header[k] for k in ("translation", "t", "position") if header.get(k) is not None), [0.0, 0.0, 0.0])
    turn = next((header[k] for k in ("rotation_matrix", "rotation", "quaternion", "q") if header.get(k) is not None), [1.0, 0.0, 0.0, 0.0])
    if isinstance(place, dict):
        place = [place[k] for k in "xyz"]
    if isinstance(turn, dict):
        turn = [turn[k] for k in "wxyz"]
    matrix = [list(map(float, r)) for r in turn] if len(turn) == 3 else rotation_of(tuple(map(float, turn)))
    dots = [[sum(a * b for a, b in zip(p, q, strict=True)) for q in matrix] for p in matrix]
    (a, b, c), (d, e, f), (g, h, i) = matrix
    off = max(abs(dots[r][s] - (r == s)) for r in range(3) for s in range(3))
    if off > 1e-6 or a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) < 0:
        raise ValueError("not a rotation")
    return list(map(float, place)), matrix


def _strided(rows: DataFrame, most: int) -> DataFrame:
    """About most rows of each station, evenly by a hash of their place."""
    sizes = rows.groupBy("station_id").agg(F.count("*").alias("_n"))
    number = F.pmod(F.xxhash64("station_id", "sample_id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(sizes), "station_id").where(number < most / F.col("_n")).drop("_n")


def steps_of_values(rows: DataFrame, value: str, span: float) -> DataFrame:
    """Columns station_id, step: the median gap between neighbouring different values, 1 / 200,000 of the span at least; the span without gaps."""
    order = Window.partitionBy("station_id").orderBy(value)
    distinct = _strided(rows, 2 * ESTIMATE_ROWS).where(F.col(value).isNotNull()).select("station_id", value).distinct()
    gaps = distinct.withColumn("gap", F.col(value) - F.lag(value).over(order))
    found = gaps.groupBy("station_id").agg(F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).alias("step"))
    return found.select("station_id", F.greatest(F.coalesce("step", F.lit(span)), F.lit(span / 200_000)).alias("step"))


def lattice_of_angles(rows: DataFrame, projected: bool) -> DataFrame:
    """One row a station: rows, cols, az_step, el_step, az0, el0, from columns az and el of returns."""
    ends = rows.groupBy("station_id").agg(F.min("az").alias("az0"), F.max("az").alias("az1"), F.min("el").alias("el0"), F.max("el").alias("el1"))
    both = ends.join(steps_of_values(rows, "az", 2 * math.pi).withColumnRenamed("step", "az_step"), "station_id").join(steps_of_values(rows, "el", math.pi).withColumnRenamed("step", "el_step"), "station_id")
    half = 2 if projected else 1
    count = lambda a, b, step: F.greatest(F.floor((F.bround((F.col(b) - F.col(a)) / F.col(step)) + 1) / half), F.lit(1)).cast("int")
    sized = both.select("station_id", count("el0", "el1", "el_step").alias("rows"), count("az0", "az1", "az_step").alias("cols"), "az_step", "el_step", "az0", "el0")
    return sized.withColumn("az_step", F.col("az_step") * half).withColumn("el_step", F.col("el_step") * half)


def index_of(angle: str, first: str, step: str, count: str) -> Column:
    """The row or column of an angle."""
    return F.least(F.greatest(F.bround((F.col(angle) - F.col(first)) / F.col(step)), F.lit(0)), F.col(count) - 1).cast("int")


def lattice_of_indices(rows: DataFrame) -> DataFrame:
    """One row a station: rows, cols and the angles of a cell, from columns row, col, az and el of returns.

    The azimuth's step is the median of differences between neighbours of a
    row, wrapped at half a turn, for each column between them; elevation is a
    straight line over rows. Where that says nothing a full sweep is taken.
    """
    size = rows.groupBy("station_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    few = _strided(rows, ESTIMATE_ROWS)
    order = Window.partitionBy("station_id", "row").orderBy("col")
    gap = F.col("col") - F.lag("col").over(order)
    pairs = few.join(F.broadcast(size), "station_id").withColumn("gap", gap).withColumn("turn", geometry.circular_gap(F.col("az"), F.lag("az").over(order)))
    step = pairs.where((F.col("gap") > 0) & (F.col("gap") < F.greatest(F.floor(F.col("cols") / 2), F.lit(1)))).groupBy("station_id").agg(F.percentile(F.col("turn") / F.col("gap"), 0.5).alias("az_step"))
    line = few.groupBy("station_id").agg(F.regr_slope("el", "row").alias("el_step"), F.regr_intercept("el", "row").alias("el0"), F.count("*").alias("n"))
    found = size.join(step, "station_id", "left").join(line, "station_id", "left")
    enough = F.coalesce(F.col("n") >= 8, F.lit(False))
    some = lambda c, default: F.when(enough & F.col(c).isNotNull() & (F.abs(F.col(c)) >= 1e-12), F.col(c)).otherwise(default)
    found = found.withColumn("az_step", some("az_step", 2 * math.pi / F.col("cols"))).withColumn("el0", F.when(enough & (F.abs(F.col("el_step")) >= 1e-12), F.col("el0")).otherwise(-math.pi / 2)).withColumn("el_step", some("el_step", math.pi / F.col("rows")))
    left = few.join(F.broadcast(found.select("station_id", "az_step")), "station_id").withColumn("rest", F.col("az") - F.col("col") * F.col("az_step"))
    first = left.groupBy("station_id").agg(F.atan2(F.avg(F.sin("rest")), F.avg(F.cos("rest"))).alias("az0"))
    return found.join(first, "station_id", "left").select("station_id", "rows", "cols", "az_step", "el_step", F.when(enough, F.col("az0")).otherwise(-math.pi).alias("az0"), "el0")


def aligned_ceiling(az_step: Column | float) -> Column:
    """The largest circular variance of azimuth that a column of a lattice has: half the square of a few steps."""
    spread = F.abs(az_step if isinstance(az_step, Column) else F.lit(az_step)) * ALIGNED_STEPS
    return F.greatest(spread * spread / 2, F.lit(ALIGNED_FLOOR))


#: What a decision about a frame is called.
PATHS = ("spherical", "no_row_column", "identity_pose", "too_few_samples", "implausible", "left_as_local", "rewritten_to_local", "undecided")


def decide_frame(evidence: DataFrame) -> DataFrame:
    """evidence (one row a station) with path, rewrite and undecided.

    Columns: has_spherical, has_row_column, posed, samples, as_local, as_world
    (mean variance of azimuth within columns, if positions are local or
    world), max_local, max_world (greatest range of either), az_step. What is
    not physical goes first; then a rewrite must be aligned and decisively
    better; without decision nothing is rewritten.
    """
    ceiling = aligned_ceiling(F.col("az_step"))
    local, world = F.col("max_local") <= MOST_RANGE, F.col("max_world") <= MOST_RANGE
    path = (
        F.when(F.col("has_spherical"), PATHS[0])
        .when(~F.col("has_row_column"), PATHS[1])
        .when(~F.col("posed"), PATHS[2])
        .when(F.col("samples") < LEAST_SAMPLES, PATHS[3])
        .when(~local & ~world, PATHS[4])
        .when(local & ~world, PATHS[5])
        .when(world & ~local, PATHS[6])
        .when((F.col("as_world") <= ceiling) & (F.col("as_world") < F.col("as_local") * DECISIVE), PATHS[6])
        .when(F.col("as_local") <= ceiling, PATHS[5])
        .otherwise(PATHS[7])
    )
    out = evidence.withColumn("path", path)
    return out.withColumn("rewrite", F.col("path") == PATHS[6]).withColumn("undecided", F.col("path").isin(PATHS[3], PATHS[4], PATHS[7]))


def column_spread(rows: DataFrame, azimuth: Column, name: str) -> DataFrame:
    """Columns station_id, name: the mean circular variance of azimuth within columns of LEAST_IN_COLUMN rows at least; 1 without such."""
    mean = rows.groupBy("station_id", "col").agg(F.avg(F.sin(azimuth)).alias("s"), F.avg(F.cos(azimuth)).alias("c"), F.count("*").alias("n"))
    variance = 1 - F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))
    return mean.groupBy("station_id").agg(F.coalesce(F.avg(F.when(F.col("n") >= LEAST_IN_COLUMN, variance)), F.lit(1.0)).alias(name))


def to_local_column(p: geometry.Vector) -> geometry.Vector:
    """World positions in the frame of a row's pose: columns t (place) and rot (rotation), arrays."""
    off = [x - F.col("t")[k] for k, x in enumerate(p)]
    return tuple(sum((F.col("rot")[i][k] * off[i] for i in range(3)), F.lit(0.0)) for k in range(3))


def frame_evidence(returns: DataFrame, stations: DataFrame, fields: list[str]) -> DataFrame:
    """The evidence for decide_frame, of returns (station_id, sample_id, col, x, y, z) and stations (station_id, t, rot).

    An even sample of FRAME_ROWS returns a station is looked at.
    """
    identity = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    far = F.sqrt(sum((F.col("t")[k] * F.col("t")[k] for k in range(3)), F.lit(0.0))) >= 0.01
    turned = F.greatest(*[F.abs(F.col("rot")[i][k] - identity[i][k]) for i in range(3) for k in range(3)]) > 2e-12
    posed = stations.select("station_id", "t", "rot", (far | turned).alias("posed"))
    flags = (F.lit(set(SPHERICAL) <= set(fields)).alias("has_spherical"), F.lit(set(ROW_COLUMN) <= set(fields)).alias("has_row_column"))
    if set(SPHERICAL) <= set(fields) or not set(ROW_COLUMN) <= set(fields):
        none = F.lit(None).cast("double")
        return posed.select("station_id", *flags, "posed", F.lit(0).cast("long").alias("samples"), *[none.alias(n) for n in ("as_local", "as_world", "max_local", "max_world")], F.lit(1.0).alias("az_step"))
    size = returns.groupBy("station_id").agg((2 * math.pi / F.greatest(F.max("col") + 1, F.lit(1))).alias("az_step"))
    own = (F.col("x"), F.col("y"), F.col("z"))
    rows = _strided(returns, FRAME_ROWS).join(F.broadcast(posed), "station_id")
    both = rows.select("station_id", "col", F.struct(*[c.alias(k) for c, k in zip(own, "xyz", strict=True)]).alias("l"), F.struct(*[c.alias(k) for c, k in zip(to_local_column(own), "xyz", strict=True)]).alias("w"))
    azimuth = {n: F.atan2(F.col(f"{n}.y"), F.col(f"{n}.x")) for n in "lw"}
    norm = {n: geometry.norm(tuple(F.col(f"{n}.{k}") for k in "xyz")) for n in "lw"}
    facts = both.groupBy("station_id").agg(F.count("*").alias("samples"), F.max(norm["l"]).alias("max_local"), F.max(norm["w"]).alias("max_world"))
    for n, name in (("l", "as_local"), ("w", "as_world")):
        facts = facts.join(column_spread(both, azimuth[n], name), "station_id")
    found = posed.join(facts, "station_id", "left").join(size, "station_id", "left")
    return found.select("station_id", *flags, "posed", F.coalesce("samples", F.lit(0)).alias("samples"), "as_local", "as_world", "max_local", "max_world", F.coalesce("az_step", F.lit(1.0)).alias("az_step"))


def plausible(rows: DataFrame, rng: str = "rng", most: float = MOST_RANGE) -> DataFrame:
    """rows, any of which raises if its range is over the limit."""
    wrong = F.raise_error(F.concat(F.lit("a range is implausible: "), F.col(rng).cast("string"))).cast(rows.schema[rng].dataType)
    return rows.withColumn(rng, F.when(F.abs(F.col(rng)) <= most, F.col(rng)).otherwise(wrong))


def stride_of(stations: DataFrame, most: int) -> DataFrame:
    """stations (rows, cols) with stride: the least k at which every k-th row and column are at most most cells."""
    return stations.withColumn("stride", F.greatest(F.ceil(F.sqrt(F.col("rows").cast("double") * F.col("cols") / most)), F.lit(1)).cast("int"))


def read_stations(raw: DataFrame, stations: DataFrame, max_points: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples (station_id, row, col, x, y, z, rng, sample_id, r, g, b, intensity) and stations with lattice, frame and counts.

    stations: station_id, t, rot. Positions are those of the scanner's frame,
    floats. With max_points every k-th row and column are kept, k for each
    station. Rows that are no returns are counted; nothing else is lost.
    """
    fields, tier = raw.columns, tier_of(raw.columns)
    place, rng = positions(fields)
    keep = ["station_id", "sample_id", *[f for f in (*SPHERICAL, *ROW_COLUMN) if f in fields]]
    shaped = colour(raw)
    extra = [c for c in ("r", "g", "b") if c in shaped.columns] + (["intensity"] if "intensity" in fields else [])
    base = shaped.select(*keep, *[c.alias(k) for c, k in zip(place, "xyz", strict=True)], rng.alias("rng"), valid(fields, rng).alias("ok"), *[intensity(raw).alias("intensity") if c == "intensity" else c for c in extra])
    # Returns are read by several aggregations; each step of theirs is a table.
    shared_folder(raw.sparkSession)
    base = base.checkpoint()
    counts = base.groupBy("station_id").agg(F.count("*").alias("source_sample_count"), F.count_if(~F.col("ok")).alias("dropped_no_return"))
    returns = base.where("ok").drop("ok")
    if tier == TIERS[0]:
        returns = returns.withColumn("col", F.col("columnIndex").cast("int")).withColumn("row", F.col("rowIndex").cast("int"))
        decided = decide_frame(frame_evidence(returns, stations, fields).checkpoint())
        frames = stations.select("station_id", "t", "rot").join(decided.select("station_id", "path", "rewrite", "undecided"), "station_id")
        joined = returns.join(F.broadcast(frames), "station_id")
        own = (F.col("x"), F.col("y"), F.col("z"))
        local = [F.when(F.col("rewrite"), a).otherwise(b) for a, b in zip(to_local_column(own), own, strict=True)]
        moved = joined.withColumns(dict(zip(("_x", "_y", "_z"), local, strict=True))).drop("x", "y", "z", "t", "rot", "path", "rewrite", "undecided")
        returns = moved.withColumnsRenamed({"_x": "x", "_y": "y", "_z": "z"}).withColumn("rng", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) if not set(SPHERICAL) <= set(fields) else F.col("rng")).checkpoint()
        azimuth, elevation, _ = geometry.spherical((F.col("x"), F.col("y"), F.col("z")))
        lattices = lattice_of_indices(returns.withColumn("az", azimuth).withColumn("el", elevation).checkpoint())
    else:
        azimuth, elevation, _ = geometry.spherical((F.col("x"), F.col("y"), F.col("z")))
        if tier == TIERS[1]:
            azimuth, elevation = F.col(SPHERICAL[1]).cast("double"), F.col(SPHERICAL[2]).cast("double")
        returns = returns.withColumn("az", azimuth).withColumn("el", elevation).checkpoint()
        lattices = lattice_of_angles(returns, tier == TIERS[2])
        indexed = returns.join(F.broadcast(lattices), "station_id")
        returns = indexed.withColumn("row", index_of("el", "el0", "el_step", "rows")).withColumn("col", index_of("az", "az0", "az_step", "cols")).drop("rows", "cols", "az_step", "el_step", "az0", "el0", "az", "el")
        path = PATHS[0] if set(SPHERICAL) <= set(fields) else PATHS[1]
        frames = stations.select("station_id", "t", "rot", F.lit(path).alias("path"), F.lit(False).alias("rewrite"), F.lit(False).alias("undecided"))
    # One row a station.
    described = frames.join(lattices, "station_id").join(counts, "station_id").withColumn("tier", F.lit(tier)).checkpoint()
    if max_points is not None:
        described = stride_of(described, max_points)
        strides = described.select("station_id", "stride")
        returns = returns.join(F.broadcast(strides), "station_id").where((F.col("row") % F.col("stride") == 0) & (F.col("col") % F.col("stride") == 0)).drop("stride")
    samples = returns.select("station_id", "row", "col", *[F.col(k).cast("float").alias(k) for k in "xyz"], F.col("rng").cast("float").alias("rng"), "sample_id", *extra)
    return plausible(samples), described
