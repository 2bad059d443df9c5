"""One station from samples to a mesh: clean, carve, restore, triangulate, cull, keep the ledger.

Samples are dealt once, to bands of band_rows lattice rows; a band also gets
the HALO rows on both sides of it, which is all that a verdict or triangle of
its own rows depends on. A task then works on dense arrays of one band (its
size is bounded by the lattice) and gives each sample its verdict, each quad
its triangles, each vertex its normal, and each band's pieces of the surface
a label. Bands meet in the vertices of the rows that they share: labels that
share a vertex are linked, and the components of these links, a table of one
row a piece and shared vertex, make the pieces whole. What is written between
is one table; nothing is collected.

What neighbouring stations saw is joined before samples are dealt, as it does
not depend on other samples: see votes.

Order and rules: despeckle; carve what is left by votes; restore carved
samples whose surviving neighbours agree, once; triangulate what is alive; cull
pieces that are small in area or number. Of samples in one cell the one with
the greatest sample_id counts; the others are not judged by neighbours and not
meshed, but carved if the votes say so. Rows without a row or col are no
samples and in no count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.operators import rangegrid, sampling
from stratagrid.operators.components import connected_components
from stratagrid.operators.lattice import DISPOSITIONS
from stratagrid.session import fresh_path

#: Rows beyond a band that its verdicts depend on: a quad's corner, its neighbour's verdict, that one's neighbours.
HALO = 3
#: Bins of a neighbour's grid that may be broadcast.
BROADCAST_BINS = 4_000_000


@dataclass(frozen=True)
class Rules:
    """All thresholds of a station, and how it is dealt."""

    tol_abs: float = 0.02
    tol_rel: float = 0.006
    min_support: int = 2
    despeckle: bool = True
    min_votes: int = 1
    restore: bool = True
    restore_support: int = 5
    max_incidence_deg: float = 82.0
    noise_floor: float = 0.012
    min_quality: float = 0.015
    min_component_area: float = 0.005
    min_component_triangles: int = 8
    band_rows: int = 64


@dataclass(frozen=True)
class Lattice:
    rows: int
    cols: int
    az_step: float
    el_step: float
    az0: float = -math.pi
    el0: float = 0.0

    @property
    def wraps(self) -> bool:
        """Whether columns go all the way round, to within two steps."""
        return abs(self.az_step * self.cols - 2 * math.pi) < 2 * self.az_step


# Arrays of one band. Rows and columns are those of the band; a missing sample has an infinite range.


def shifted(values: np.ndarray, dr: int, dc: int, wrap: bool, missing) -> np.ndarray:
    """values of the cell dr rows and dc columns away."""
    out = np.roll(values, (-dr, -dc), axis=(0, 1))
    if dr > 0:
        out[-dr:] = missing
    elif dr < 0:
        out[:-dr] = missing
    if not wrap and dc:
        out[:, (slice(-dc, None) if dc > 0 else slice(None, -dc))] = missing
    return out


AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]


def support(rng: np.ndarray, counted: np.ndarray, wrap: bool, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """For each cell how many of the eight neighbours are counted, and how many of these agree with it."""
    there, agree = np.zeros(rng.shape, np.int8), np.zeros(rng.shape, np.int8)
    seen = np.where(counted, rng, np.inf)
    slack = rules.tol_abs + rules.tol_rel * rng
    with np.errstate(invalid="ignore"):
        for dr, dc in AROUND:
            other = shifted(seen, dr, dc, wrap, np.inf)
            there += other < np.inf
            agree += np.abs(other - rng) <= slack
    return there, agree


def verdicts(rng: np.ndarray, votes: np.ndarray, wrap: bool, rules: Rules, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which cells are kept by despeckling, which of these are carved, and which of these come back."""
    present = rng < np.inf
    kept = present.copy()
    if rules.despeckle:
        there, agree = support(rng, present, wrap, rules)
        kept &= ~((there >= rules.min_support) & (agree < rules.min_support))
    carved = kept & (votes >= need) if need else np.zeros_like(kept)
    back = np.zeros_like(kept)
    if rules.restore and carved.any():
        back = carved & (support(rng, kept & ~carved, wrap, rules)[1] >= rules.restore_support)
    return kept, carved, back


#: The triangles that a quad can have, by its corners a b / c d, in their winding order.
WAYS = ("acb", "bcd", "acd", "adb")


def quad_triangles(rng: np.ndarray, place: np.ndarray, alive: np.ndarray, wrap: bool, step: float, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Triangles as flat cell numbers of the arrays, with their areas; quad rows in order.

    step: the coarser of the lattice's two angles. Ranges and places of cells that aren't alive don't matter.
    """
    rows, cols = rng.shape
    wide = cols if wrap else cols - 1
    at = np.arange(rows * cols).reshape(rows, cols)
    corner = {"a": at[:-1, :wide], "b": np.roll(at, -1, axis=1)[:-1, :wide], "c": at[1:, :wide], "d": np.roll(at, -1, axis=1)[1:, :wide]}
    # Only quads with three corners go on.
    quads = np.flatnonzero(sum(alive.ravel()[x].astype(np.int8) for x in corner.values()).ravel() >= 3)
    corner = {n: x.ravel()[quads] for n, x in corner.items()}
    there = {n: alive.ravel()[x] for n, x in corner.items()}
    p = {n: place.reshape(-1, 3)[x] for n, x in corner.items()}
    far = {n: rng.ravel()[x] for n, x in corner.items()}
    edge = {n: np.sqrt(((p[n[0]] - p[n[1]]) ** 2).sum(axis=1)) for n in ("ab", "ac", "ad", "bc", "bd", "cd")}
    reach = step * math.tan(math.radians(min(rules.max_incidence_deg, 89.5)))
    area, good = {}, {}
    with np.errstate(invalid="ignore", divide="ignore"):
        for way in WAYS:
            x, y, z = way
            across = np.cross(p[y] - p[x], p[z] - p[x])
            area[way] = 0.5 * np.sqrt((across * across).sum(axis=1))
            longest = np.maximum.reduce([edge["".join(sorted(e))] for e in (x + y, y + z, z + x)])
            limit = np.maximum(rules.noise_floor, np.maximum.reduce([far[x], far[y], far[z]]) * reach)
            good[way] = (longest < limit) & (2 * area[way] / (longest * longest) > rules.min_quality) & there[x] & there[y] & there[z]
    full = there["a"] & there["b"] & there["c"] & there["d"]
    by_bc, by_ad = full & good["acb"] & good["bcd"], full & good["acd"] & good["adb"]
    by_bc &= ~by_ad | (edge["bc"] <= edge["ad"])
    by_ad &= ~by_bc
    alone = {"acb": ~there["d"], "bcd": ~there["a"], "acd": ~there["b"], "adb": ~there["c"]}
    chosen = {way: np.flatnonzero((by_bc if way in ("acb", "bcd") else by_ad) | (alone[way] & good[way])) for way in WAYS}
    triangles = np.concatenate([np.stack([corner[n][k] for n in way], axis=1) for way, k in chosen.items()])
    areas = np.concatenate([area[way][k] for way, k in chosen.items()])
    order = np.argsort(np.concatenate([quads[k] for k in chosen.values()]), kind="stable")
    return triangles[order], areas[order]


def labels(n: int, triangles: np.ndarray) -> np.ndarray:
    """For each of n vertices the least vertex that triangles connect it with."""
    root = np.arange(n)
    while len(triangles):
        low = root[triangles].min(axis=1)
        before = root.copy()
        for k in range(3):
            np.minimum.at(root, before[triangles[:, k]], low)
        while (jump := root[root]).tobytes() != root.tobytes():
            root = jump
        if (root == before).all():
            break
        # Triangles of one label are done.
        now = root[triangles]
        triangles = triangles[(now != now[:, :1]).any(axis=1)]
    return root


def normals(n: int, place: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Unit normals of n vertices, weighted by area, towards the scanner; zero where there is none."""
    p, q, r = (place[triangles[:, k]] for k in range(3))
    face = np.cross(q - p, r - p)
    total = np.stack([sum(np.bincount(triangles[:, k], face[:, j], n) for k in range(3)) for j in range(3)], axis=1).astype(float)
    size = np.sqrt((total * total).sum(axis=1))
    total[size > 0] /= size[size > 0, None]
    total[(total * place).sum(axis=1) > 0] *= -1
    return total


SAMPLES = pa.schema([
    ("kind", pa.string()), ("station_id", pa.string()), ("band", pa.int32()), ("sample_id", pa.int64()), ("row", pa.int32()), ("col", pa.int32()), ("cell", pa.int64()),
    ("x", pa.float32()), ("y", pa.float32()), ("z", pa.float32()), ("verdict", pa.string()), ("restored", pa.bool_()), ("root", pa.int64()),
    ("nx", pa.float32()), ("ny", pa.float32()), ("nz", pa.float32()), ("c0", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("area", pa.float32()),
])
OUTPUT = ", ".join(f"{f.name} {({'int32': 'int', 'int64': 'long', 'float': 'float', 'bool': 'boolean'}).get(str(f.type), str(f.type))}" for f in SAMPLES)


def work_band(table: pa.Table, band: int, lattice: Lattice, rules: Rules, need: int) -> Iterator[pa.RecordBatch]:
    """All that a band gives: its samples, its triangles, and which labels hold its border vertices."""
    first, cols = band * rules.band_rows, lattice.cols
    stop, base = first + rules.band_rows, first - HALO
    order = np.lexsort([table.column(k).to_numpy() for k in ("sample_id", "col", "row")])
    row, col, ids, votes = (table.column(k).to_numpy()[order] for k in ("row", "col", "sample_id", "votes"))
    place = np.stack([table.column(k).to_numpy()[order] for k in "xyz"], axis=1).astype(np.float64)
    rng = table.column("rng").to_numpy()[order].astype(np.float64)
    station = table.column("station_id")[0].as_py()
    shape = (rules.band_rows + 2 * HALO, cols)
    cell = (row - base).astype(np.int64) * cols + col
    # The last of the samples in a cell is the one that is left here.
    holder = np.full(shape[0] * cols, -1)
    holder[cell] = np.arange(len(cell))
    held = holder >= 0
    dense = np.full(len(held), np.inf)
    dense[held] = rng[holder[held]]
    spots, seen = np.zeros((len(held), 3)), np.zeros(len(held), np.int64)
    spots[held], seen[held] = place[holder[held]], votes[holder[held]]
    kept, carved, back = verdicts(dense.reshape(shape), seen.reshape(shape), lattice.wraps, rules, need)
    alive = kept & (~carved | back)
    # Quads of the band's rows and of the one before, whose lower corners are the band's.
    part = slice(HALO - 1, HALO + rules.band_rows + 1)
    own, areas = quad_triangles(dense.reshape(shape)[part], spots.reshape(*shape, 3)[part], alive[part], lattice.wraps, max(abs(lattice.az_step), abs(lattice.el_step)), rules)
    n, start = (rules.band_rows + 2) * cols, (first - 1) * cols
    root = labels(n, own) + start
    used = np.zeros(n, bool)
    used[own.ravel()] = True
    facing = normals(n, spots[part.start * cols : part.stop * cols], own)

    mine = np.flatnonzero((row >= first) & (row < stop))
    at = cell[mine]
    holds = holder[at] == mine
    k, c, b = (x.ravel()[at] for x in (kept, carved, back))
    lost = np.where(holds, ~k, False)
    taken = np.where(holds, c & ~b, need > 0 and votes[mine] >= need)
    verdict = np.select([lost, taken, ~holds], ["dropped_despeckle", "dropped_mover_carve", "dropped_other"], "")
    left_out = verdict == ""
    local = at - (HALO - 1) * cols
    meshed = holds & used[local]
    yield _batch(
        len(mine), kind="sample", station_id=station, band=band, sample_id=ids[mine], row=row[mine], col=col[mine], cell=row[mine].astype(np.int64) * cols + col[mine],
        x=place[mine, 0], y=place[mine, 1], z=place[mine, 2], verdict=pa.array(verdict.astype(object), pa.string(), mask=left_out), restored=holds & b,
        root=pa.array(root[local], mask=~meshed), nx=facing[local, 0], ny=facing[local, 1], nz=facing[local, 2],
    )
    # The quads above the band belong to the one before.
    belongs = own.min(axis=1) >= cols if len(own) else np.zeros(0, bool)
    faces = own[belongs]
    yield _batch(len(faces), kind="triangle", station_id=station, band=band, c0=faces[:, 0] + start, c1=faces[:, 1] + start, c2=faces[:, 2] + start, area=areas[belongs], root=root[faces[:, 0]] if len(faces) else np.zeros(0, np.int64))
    shared = np.r_[np.arange(cols, 2 * cols), np.arange((rules.band_rows + 1) * cols, n)]
    shared = shared[used[shared]]
    yield _batch(len(shared), kind="border", station_id=station, band=band, cell=shared + start, root=root[shared])


def _batch(n: int, **columns) -> pa.RecordBatch:
    out = []
    for f in SAMPLES:
        value = columns.get(f.name)
        if value is None:
            out.append(pa.nulls(n, f.type))
        elif isinstance(value, (str, int)):
            out.append(pa.repeat(pa.scalar(value, f.type), n) if n else pa.nulls(0, f.type))
        elif isinstance(value, pa.Array):
            out.append(value.cast(f.type))
        else:
            out.append(pa.array(np.asarray(value), pa.from_numpy_dtype(np.asarray(value).dtype)).cast(f.type, safe=False))
    return pa.RecordBatch.from_arrays(out, schema=SAMPLES)


#: What samples need to go through bands.
VOTED = ("station_id", "row", "col", "sample_id", "x", "y", "z", "rng", "votes")


def bands_of(row: Column, rows: int, band_rows: int) -> Column:
    """The bands that a row's samples change, as an array."""
    lowest, highest = (F.floor((row + d) / band_rows).cast("int") for d in (-HALO, HALO))
    return F.sequence(F.greatest(lowest, F.lit(0)), F.least(highest, F.lit((rows - 1) // band_rows)))


def on_lattice(samples: DataFrame, lattice: Lattice) -> DataFrame:
    """Samples of a lattice's cells; a row or column that it does not have raises, a null one is no sample."""
    inside = F.col("row").between(0, lattice.rows - 1) & F.col("col").between(0, lattice.cols - 1)
    outside = F.raise_error(F.concat(F.lit("a sample is off its lattice: row "), F.col("row").cast("string"), F.lit(", column "), F.col("col").cast("string"))).cast("int")
    return samples.where("row is not null and col is not null").withColumn("row", F.when(inside, F.col("row")).otherwise(outside))


def worked(samples: DataFrame, lattice: Lattice, rules: Rules, need: int, dealt: bool = False) -> DataFrame:
    """Samples (with votes) through their bands: rows of the kinds sample, triangle and border.

    dealt: samples have a column band already and are there once for each band that they change.
    """
    given, fixed, wanted = asdict(lattice), asdict(rules), need
    if dealt:
        dealt_rows = samples.select(*VOTED, "band")
    else:
        own = on_lattice(samples, lattice).select(*VOTED)
        dealt_rows = own.withColumn("band", F.explode(bands_of(F.col("row"), lattice.rows, rules.band_rows)))

    def work(key, table):
        rules_ = Rules(**fixed)
        return pa.Table.from_batches(list(work_band(table, key[1].as_py(), Lattice(**given), rules_, wanted)), SAMPLES)

    return dealt_rows.groupBy("station_id", "band").applyInArrow(work, OUTPUT)


# Neighbours.


def grid_of(samples: DataFrame, width: int, height: int, fill: bool = True) -> DataFrame:
    """Columns u, v, r: the nearest return of each direction of a station's own samples."""
    u, v = rangegrid.direction_bin(*[F.col(k).cast("double") for k in "xyz"], width, height)
    rows = samples.where("row is not null and col is not null").select(u.alias("u"), v.alias("v"), F.col("rng").cast("double").alias("rng"))
    grid = rangegrid.range_grid(rows, ["u", "v"])
    return rangegrid.close_holes(grid, width, height).select("u", "v", "r") if fill else grid


def grid_shape(rows: int, cols: int, most: int = 16_000_000) -> tuple[int, int]:
    """Width and height of a station's grid: its lattice's, made smaller in both alike beyond a number of bins."""
    shrink = min(1.0, math.sqrt(most / max(1, rows * cols)))
    return max(1, int(cols * shrink)), max(1, int(rows * shrink))


def turned(p, rotation: list[list[float]]):
    return tuple(sum((F.lit(float(a)) * x for a, x in zip(line, p, strict=True)), F.lit(0.0)) for line in rotation)


def votes(samples: DataFrame, pose: tuple[list[float], list[list[float]]], others: list[tuple[DataFrame, tuple, tuple[int, int]]], clear_margin: float = 0.4, relative_margin: float = 1.02) -> DataFrame:
    """samples with votes: how many of the others saw clearly beyond each.

    others: for each neighbour its grid, its pose (place, rotation) and its grid's shape.
    """
    here = turned(tuple(F.col(k).cast("double") for k in "xyz"), pose[1])
    world = tuple(x + float(t) for x, t in zip(here, pose[0], strict=True))
    out = samples.withColumn("votes", F.lit(0).cast("long"))
    for grid, (place, rotation), (width, height) in others:
        away = tuple(x - float(t) for x, t in zip(world, place, strict=True))
        back = turned(away, [list(c) for c in zip(*rotation, strict=True)])
        u, v = rangegrid.direction_bin(*back, width, height)
        far = F.sqrt(sum((x * x for x in back), F.lit(0.0)))
        keyed = out.withColumn("_bin", u * height + v).withColumn("_far", far)
        bins = grid.select((F.col("u") * height + F.col("v")).alias("_bin"), F.col("r").alias("_r"))
        bins = F.broadcast(bins) if width * height <= BROADCAST_BINS else bins
        beyond = (F.col("_r") > F.col("_far") + clear_margin) & (F.col("_r") > F.lit(relative_margin) * F.col("_far"))
        joined = keyed.join(bins, "_bin", "left")
        out = joined.withColumn("votes", F.col("votes") + F.coalesce(beyond, F.lit(False)).cast("long")).drop("_bin", "_far", "_r")
    return out


# The whole.


@dataclass
class Meshed:
    """A station's results as tables.

    samples: sample_id, row, col, cell, x, y, z, disposition, restored, normal.
    triangles: c0, c1, c2 (cells), area, component. ledger: one row a station.
    """

    samples: DataFrame
    triangles: DataFrame
    ledger: DataFrame

    def vertices(self) -> DataFrame:
        """The vertices that triangles use, numbered by cell from 0: gid, cell, sample_id, row, x, y, z, nx, ny, nz."""
        kept = self.samples.where("disposition = 'retained'").select("cell", "sample_id", "row", "x", "y", "z", "nx", "ny", "nz")
        return sampling.dense_rank(kept, "cell", "gid")


def mesh_station(samples: DataFrame, lattice: Lattice, rules: Rules | None = None, pose: tuple | None = None, others: list | None = None, source_sample_count: int | None = None) -> Meshed:
    """The mesh of one station's samples (station_id, row, col, x, y, z, rng, sample_id), see the module.

    others are grids of neighbouring stations as votes takes them; with them
    the station's pose is needed. source_sample_count: the samples that the
    source had, with those that never returned.
    """
    rules, others = rules or Rules(), others or []
    need = max(1, min(rules.min_votes, len(others))) if others else 0
    voted = votes(samples, pose, others) if others else samples.withColumn("votes", F.lit(0).cast("long"))
    return mesh_voted(voted, lattice, rules, need, source_sample_count)


def mesh_voted(voted: DataFrame, lattice: Lattice, rules: Rules, need: int, source_sample_count: int | None = None) -> Meshed:
    """The mesh of samples whose votes are known; a sample is carved at need votes, never if need is 0."""
    path = fresh_path(voted.sparkSession, "station")
    worked(voted, lattice, rules, need).write.partitionBy("kind").parquet(path)
    return finished(voted.sparkSession.read.schema(OUTPUT).parquet(path), rules, source_sample_count)


def finished(rows: DataFrame, rules: Rules, source_sample_count: int | None = None) -> Meshed:
    """Whole components, the cull and the ledger, from what bands gave."""
    pieces = rows.where("kind = 'triangle'").groupBy("station_id", "root").agg(F.count("*").alias("n"), F.sum(F.col("area").cast("double")).alias("area"))
    node = lambda c: F.struct("station_id", F.col(c).alias("cell"))
    links = rows.where("kind = 'border'").select(node("root").alias("src"), node("cell").alias("dst"))
    whole = connected_components(links).select(F.col("node.station_id").alias("station_id"), F.col("node.cell").alias("root"), F.col("root.cell").alias("component"))
    named = pieces.join(whole, ["station_id", "root"], "left").withColumn("component", F.coalesce("component", "root"))
    size = named.groupBy("station_id", "component").agg(F.sum("n").alias("n"), F.sum("area").alias("total"))
    large = (F.col("total") >= rules.min_component_area) & (F.col("n") >= rules.min_component_triangles) if rules.min_component_area > 0 else F.lit(True)
    # A border vertex can be a label of a piece whose triangles are the band's before.
    roots = whole.select("station_id", "root", "component").unionByName(named.select("station_id", "root", "component")).distinct()
    kept = roots.join(size.where(large).select("station_id", "component"), ["station_id", "component"])
    triangles = rows.where("kind = 'triangle'").select("station_id", "c0", "c1", "c2", "area", "root").join(kept, ["station_id", "root"])
    samples = rows.where("kind = 'sample'").drop("kind", "c0", "c1", "c2", "area").join(kept.withColumn("kept", F.lit(True)), ["station_id", "root"], "left")
    disposition = F.coalesce("verdict", F.when(F.col("root").isNull(), "dropped_other").when(F.col("kept"), "retained").otherwise("dropped_island"))
    judged = samples.select("station_id", "sample_id", "row", "col", "cell", "x", "y", "z", "nx", "ny", "nz", "restored", disposition.alias("disposition"))
    return Meshed(judged, triangles.select("station_id", "c0", "c1", "c2", "area", "component"), ledger(judged, source_sample_count))


def ledger(samples: DataFrame, source_sample_count: int | None = None) -> DataFrame:
    """One row a station: where its samples ended, what came back, and whether it adds up."""
    counts = samples.groupBy("station_id").agg(F.count("*").alias("returned"), *[F.count_if(F.col("disposition") == d).alias(d) for d in DISPOSITIONS if d != "dropped_no_return"], F.count_if("restored").alias("restored_from_carve"))
    source = F.lit(source_sample_count).cast("long") if source_sample_count is not None else F.col("returned")
    counts = counts.withColumn("input_points", source).withColumn("dropped_no_return", source - F.col("returned"))
    balanced = (F.col("input_points") == sum((F.col(d) for d in DISPOSITIONS), F.lit(0))) & (F.col("dropped_no_return") >= 0)
    return counts.select("station_id", "input_points", *DISPOSITIONS, "restored_from_carve", balanced.alias("balanced"))
