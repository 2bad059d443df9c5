"""Decimation by quadric edge collapse, in rounds of collapses that don't touch each other; each patch within one task.

Patches meet at vertices that several patches use; those and the ends of
boundary edges are locked, so patches can be decimated apart from each other
and still fit. Vertices of several patches and how large patches are is found
by aggregations; an edge that meets no other patch has all of its triangles in
its own, where its uses are counted. A patch of more triangles than a task
should hold is cut along its cell numbers into pieces that are patches of
their own; the cut locks the vertices on it.

Each patch's vertices, once each, and its triangles stream through a task in
the order of the patches; small patches are worked on together, so that many
of them cost little more than their triangles.

A round looks at all edges of its patches at once, in arrays. Each edge gets the
place of least quadric error, its cost there, and whether its collapse is
allowed. Of the allowed ones those are carried out that are cheaper than every
other allowed edge with an end next to theirs; the faces that they change are
then apart from each other, so their order does not matter. Rounds go on until
no edge is allowed or the patch is small enough. Only edges near what a round
changed are looked at anew.

What allows a collapse: not both ends are locked (a locked one keeps its
place); the root of the cost is at most max_error; the bound of the distance
from every plane that was merged into the vertex is at most
max_plane_deviation; the ends have just as many common neighbours as common
faces, one or two; no edge between locked vertices would appear; no face that
stays would turn by more than max_turn_deg or fall flat. target_triangles, or
the patch's triangles over reduction, ends it. Of equal costs the edge with
the smaller vertex numbers goes first, so results don't depend on row order.

Edge cases: degenerate triangles have no plane and are left out. Rows without
a patch (null) are one patch; patch ids are not negative. A triangle with a
vertex that the table of vertices lacks raises. Of a vertex that it has several
times the largest place counts, as in triangulation. An empty mesh gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.operators import mesh, surface

#: Triangles that a task holds at most.
MOST_TRIANGLES = 500_000
DONE = "kind string, patch long, c0 long, c1 long, c2 long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, bound double"
#: Pairs of an edge and a face that are looked at at once.
PAIRS_AT_ONCE = 1_000_000
#: Rows of small patches, vertices and triangles, that are worked on together, about.
ROWS_AT_ONCE = 40_000


@dataclass(frozen=True)
class Settings:
    max_error: float = math.inf
    max_plane_deviation: float = math.inf
    target_triangles: int = 0
    reduction: float | None = None
    max_turn_deg: float = 90.0


def face_planes(points: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals with offsets, and areas, of faces that have one."""
    across = np.cross(points[faces[:, 1]] - points[faces[:, 0]], points[faces[:, 2]] - points[faces[:, 0]])
    size = np.sqrt((across * across).sum(axis=1))
    unit = across / size[:, None]
    return np.c_[unit, -(unit * points[faces[:, 0]]).sum(axis=1)], size / 2


def quadric_costs(quadrics: np.ndarray, places: np.ndarray) -> np.ndarray:
    full = np.c_[places, np.ones(len(places))]
    return np.einsum("ni,nij,nj->n", full, quadrics, full)


def edges_of(n: int, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of faces over n vertices in ascending order, as smaller end times n plus larger end, and how many faces each has."""
    p, q = faces.ravel(), faces[:, [1, 2, 0]].ravel()
    code = np.sort(np.minimum(p, q) * n + np.maximum(p, q))
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.r_[first, len(code)])


def listed(n: int, owner: np.ndarray, value: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of each of n owners begin, and all of them in ascending order; values are below the last number."""
    code = np.sort(owner * values + value)
    return np.searchsorted(code, np.arange(n + 1) * values), code % max(values, 1)


def spread(starts: np.ndarray, values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number in of all its values, as pairs of the place in of and the value."""
    sizes = starts[of + 1] - starts[of]
    at = np.repeat(np.arange(len(of)), sizes)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return at, values[starts[of][at] + inner]


class Collapser:
    """Patches in arrays; part has the number of each vertex's patch, without one all are of patch 0. Patches share no vertex."""

    def __init__(self, points: np.ndarray, faces: np.ndarray, locked: np.ndarray, settings: Settings, part: np.ndarray | None = None):
        self.points, self.locked, self.settings = points.astype(float).copy(), locked.astype(bool), settings
        self.part = np.zeros(len(points), np.int64) if part is None else part
        self.parts = int(self.part.max(initial=0)) + 1
        across = np.cross(points[faces[:, 1]] - points[faces[:, 0]], points[faces[:, 2]] - points[faces[:, 0]])
        self.faces = faces[(across * across).sum(axis=1) > 0]
        planes, areas = face_planes(self.points, self.faces)
        self.quadrics = np.zeros((len(points), 4, 4))
        for i in range(4):
            for j in range(i, 4):
                each = planes[:, i] * planes[:, j] * areas
                self.quadrics[:, i, j] = self.quadrics[:, j, i] = sum(np.bincount(self.faces[:, k], each, len(points)) for k in range(3))
        self.least = np.full(len(points), np.inf)
        for k in range(3):
            np.minimum.at(self.least, self.faces[:, k], areas)
        self.keeper = np.arange(len(points))
        self.bounds, self.rounds = np.zeros(self.parts), 0
        given = np.bincount(self.part[faces[:, 0]], minlength=self.parts)
        self.target = np.maximum(settings.target_triangles, np.ceil(given / settings.reduction).astype(np.int64) if settings.reduction else 0)
        self.turn = math.cos(math.radians(settings.max_turn_deg))

    @property
    def bound(self) -> float:
        return float(self.bounds.max())

    def triangles(self) -> np.ndarray:
        """How many faces each patch has."""
        return np.bincount(self.part[self.faces[:, 0]], minlength=self.parts)

    def places(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each edge's ends go, and the cost there."""
        q = self.quadrics[u] + self.quadrics[v]
        options = np.stack([self.points[u], self.points[v], (self.points[u] + self.points[v]) / 2])
        costs = np.stack([quadric_costs(q, o) for o in options])
        pick = costs.argmin(axis=0)
        every = np.arange(len(u))
        spot, cost = options[pick, every], costs[pick, every]
        a = q[:, :3, :3]
        scale = np.abs(a).max(axis=(1, 2))
        free = ~self.locked[u] & ~self.locked[v] & (scale > 0)
        solvable = free.copy()
        solvable[free] = np.abs(np.linalg.det(a[free] / scale[free, None, None])) > 1e-10
        if solvable.any():
            best = np.linalg.solve(a[solvable], -q[solvable, :3, 3][..., None])[..., 0]
            spot[solvable], cost[solvable] = best, quadric_costs(q[solvable], best)
        for end, k in ((u, 0), (v, 1)):
            held = self.locked[end]
            spot[held], cost[held] = options[k, held], costs[k, held]
        return spot, np.maximum(cost, 0.0)

    def look_at(self, edges: np.ndarray, uses: np.ndarray, starts: np.ndarray, near: np.ndarray, of_faces: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each edge whether it may collapse, and its place and cost if it is not ruled out before them."""
        own, n = self.settings, len(self.points)
        spot, cost, allowed = np.zeros((len(edges), 3)), np.zeros(len(edges)), np.zeros(len(edges), bool)
        on = np.flatnonzero(~self.locked[edges].all(axis=1) & (uses <= 2))
        u, v = edges[on, 0], edges[on, 1]
        spot[on], cost[on] = self.places(u, v)
        on = on[(np.sqrt(cost[on]) <= own.max_error) & (np.sqrt(cost[on] / np.minimum(self.least[u], self.least[v])) <= own.max_plane_deviation)]
        u, v = edges[on, 0], edges[on, 1]
        known = np.repeat(np.arange(n), np.diff(starts)) * n + near
        keep, drop = np.where(self.locked[v], v, u), np.where(self.locked[v], u, v)
        at, other = spread(starts, near, drop)
        code = keep[at] * n + other
        common = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
        fresh = ~common & (other != keep[at]) & self.locked[other] & self.locked[keep[at]]
        allowed[on] = (np.bincount(at, common, len(on)) == uses[on]) & (np.bincount(at, fresh, len(on)) == 0)
        u, v = edges[:, 0], edges[:, 1]
        for end in (u, v):
            on = np.flatnonzero(allowed)
            step = max(1, PAIRS_AT_ONCE // 8)
            for a in range(0, len(on), step):
                part = on[a : a + step]
                k, face = spread(*of_faces, end[part])
                corners = self.faces[face]
                mine = (corners == u[part][k, None]) | (corners == v[part][k, None])
                stays = mine.sum(axis=1) == 1
                k, corners, mine = k[stays], corners[stays], mine[stays]
                old = self.points[corners]
                new = np.where(mine[:, :, None], spot[part][k][:, None, :], old)
                p, q = (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) for t in (old, new))
                size = np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
                bad = (size <= 0) | ((p * q).sum(axis=1) < self.turn * size)
                allowed[part[np.bincount(k, bad, len(part)) > 0]] = False
        return spot, cost, allowed

    def run(self) -> None:
        n = len(self.points)
        seen = np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros(0), np.zeros(0, bool)
        touched = np.ones(n, bool)
        going, done = np.ones(self.parts, bool), []
        while len(self.faces):
            # Patches that are small enough or have no edge to collapse are put by.
            left = self.triangles()
            going &= left > self.target
            stays = going[self.part[self.faces[:, 0]]]
            done.append(self.faces[~stays])
            self.faces = self.faces[stays]
            if not len(self.faces):
                break
            code, uses = edges_of(n, self.faces)
            edges = np.stack(np.divmod(code, n), axis=1)
            starts, near = listed(n, edges.T.ravel(), edges.T[::-1].ravel(), n)
            of_faces = listed(n, self.faces.ravel(), np.repeat(np.arange(len(self.faces)), 3), len(self.faces))
            spot, cost, allowed = np.zeros((len(edges), 3)), np.zeros(len(edges)), np.zeros(len(edges), bool)
            anew = touched[edges].any(axis=1)
            at = np.searchsorted(seen[0], code[~anew])
            for now, before in zip((spot, cost, allowed), seen[1:], strict=True):
                now[~anew] = before[at]
            for now, found in zip((spot, cost, allowed), self.look_at(edges[anew], uses[anew], starts, near, of_faces), strict=True):
                now[anew] = found
            seen = code, spot, cost, allowed
            on = np.flatnonzero(allowed)
            going = np.bincount(self.part[edges[on, 0]], minlength=self.parts) > 0
            if not len(on):
                continue
            # Edges are in the order of their ends, which breaks ties.
            on = on[np.argsort(cost[on], kind="stable")]
            rank = np.arange(len(on))
            first = np.full(n, len(on))
            for k in range(2):
                np.minimum.at(first, edges[on, k], rank)
            around = first.copy()
            np.minimum.at(around, edges[:, 0], first[edges[:, 1]])
            np.minimum.at(around, edges[:, 1], first[edges[:, 0]])
            chosen = on[np.minimum(around[edges[on, 0]], around[edges[on, 1]]) == rank]
            # Of each patch the cheapest, half as many as it has triangles too many.
            owner = self.part[edges[chosen, 0]]
            order = np.argsort(owner, kind="stable")
            sizes = np.bincount(owner, minlength=self.parts)
            place = np.empty(len(chosen), np.int64)
            place[order] = np.arange(len(chosen)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            chosen = chosen[place < -(-(left - self.target) // 2)[owner]]
            touched = self.carry_out(edges[chosen], spot[chosen], cost[chosen], starts, near)
            self.rounds += 1
        self.faces = np.concatenate([*done, self.faces])

    def carry_out(self, edges: np.ndarray, spot: np.ndarray, cost: np.ndarray, starts: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Collapses edges that don't touch each other; which vertices' edges are to be looked at anew."""
        u, v = edges[:, 0], edges[:, 1]
        keep, drop = np.where(self.locked[v], v, u), np.where(self.locked[v], u, v)
        np.maximum.at(self.bounds, self.part[u], np.sqrt(cost / np.minimum(self.least[u], self.least[v])))
        touched = np.zeros(len(self.points), bool)
        for end in (u, v):
            touched[spread(starts, near, end)[1]] = True
        self.points[keep] = spot
        self.quadrics[keep] += self.quadrics[drop]
        self.least[keep] = np.minimum(self.least[keep], self.least[drop])
        self.keeper[drop] = keep
        goes = np.arange(len(self.points))
        goes[drop] = keep
        faces = goes[self.faces]
        self.faces = faces[(faces[:, 0] != faces[:, 1]) & (faces[:, 1] != faces[:, 2]) & (faces[:, 2] != faces[:, 0])]
        return touched

    def survivors(self) -> np.ndarray:
        """For each vertex the one that stands for it."""
        out = self.keeper
        while (out != out[out]).any():
            out = out[out]
        return out


def locked_cells(triangles: DataFrame) -> DataFrame:
    """Column cell: vertices of more than one patch, and ends of edges with one triangle or more than two."""
    corners = triangles.select(F.coalesce("patch", F.lit(-1)).alias("patch"), F.explode(F.array("c0", "c1", "c2")).alias("cell"))
    meeting = corners.groupBy("cell").agg(F.min("patch").alias("a"), F.max("patch").alias("b")).where("a <> b").select("cell")
    rim = mesh.edge_use(triangles.select("c0", "c1", "c2")).where("uses <> 2").select(F.explode(F.array("e0", "e1")).alias("cell"))
    return meeting.unionByName(rim).distinct()


def oversize(triangles: DataFrame, max_triangles: int = MOST_TRIANGLES) -> DataFrame:
    """Columns patch, triangles of the patches that are cut into pieces."""
    return triangles.groupBy("patch").agg(F.count("*").alias("triangles")).where(F.col("triangles") > max_triangles)


def cut(triangles: DataFrame, max_triangles: int = MOST_TRIANGLES) -> DataFrame:
    """triangles with piece: 0, or for patches that are too large the number of a run of cells."""
    large = oversize(triangles, max_triangles).select(F.coalesce("patch", F.lit(-1)).alias("_key"), F.col("triangles").alias("_size"))
    # Each has more than max_triangles of all triangles, so there are few.
    keyed = triangles.withColumn("_key", F.coalesce("patch", F.lit(-1))).join(F.broadcast(large), "_key", "left")
    order = Window.partitionBy("_key").orderBy("c0", "c1", "c2")
    whole = keyed.where("_size is null").withColumn("piece", F.lit(0))
    pieces = keyed.where("_size is not null").withColumn("piece", F.floor((F.row_number().over(order) - 1) / max_triangles).cast("int"))
    return whole.unionByName(pieces).drop("_key", "_size")


def _rows(kind: str, patch: pa.Array, cells: list[np.ndarray], places: list[np.ndarray], bound: np.ndarray) -> pa.RecordBatch:
    """Rows of one kind; of cells and places that it lacks null."""
    n = len(bound)
    columns = [pa.repeat(kind, n), patch]
    columns += [pa.array(cells[k]) if k < len(cells) else pa.nulls(n, pa.int64()) for k in range(3)]
    columns += [pa.array(np.ascontiguousarray(places[k][:, j]), from_pandas=True) if k < len(places) else pa.nulls(n, pa.float64()) for k in range(3) for j in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(bound)], [f.split()[0] for f in DONE.split(", ")])


def _numbers(rows: pa.Table) -> np.ndarray:
    """For each row the number of its patch and piece among those of rows, which are in their order."""
    if not len(rows):
        return np.zeros(0, np.int64)
    patch, piece = rows["patch"].fill_null(-1).to_numpy(), rows["piece"].to_numpy()
    return np.cumsum(np.r_[False, (patch[1:] != patch[:-1]) | (piece[1:] != piece[:-1])])


def _decimated(rows: pa.Table, settings: Settings, with_vertices: bool) -> Iterator[pa.RecordBatch]:
    """Decimates whole patches, which lie one behind the other."""
    number, face = _numbers(rows), rows["face"].to_numpy()
    cell = rows["c0"].to_numpy()
    # Of several places of one vertex the largest counts, null below all numbers and NaN above.
    corner = np.flatnonzero(~face)
    given = [rows[k].filter(pa.array(~face)) for k in "xyz"]
    places = np.stack([k.to_numpy() for k in given], axis=1)
    order = np.lexsort([*[k.fill_null(-np.inf).to_numpy() for k in given[::-1]], cell[corner], number[corner]])
    corner, places = corner[order], places[order]
    last = np.r_[(cell[corner[1:]] != cell[corner[:-1]]) | (number[corner[1:]] != number[corner[:-1]]), True]
    corner, places = corner[last], places[last]
    part, cells, locked = number[corner], cell[corner], rows["locked"].to_numpy()[corner]
    names = np.unique(cells)
    known = part * len(names) + np.searchsorted(names, cells)
    rows_of = np.flatnonzero(face)
    ids = np.stack([rows[f"c{k}"].filter(pa.array(face)).to_numpy() for k in range(3)], axis=1)
    order = np.lexsort([ids[:, 2], ids[:, 1], ids[:, 0], number[rows_of]])
    rows_of, ids = rows_of[order], ids[order]
    faces = np.searchsorted(known, number[rows_of][:, None] * len(names) + np.searchsorted(names, ids))
    n = len(cells)
    code, uses = edges_of(n, faces)
    locked[np.concatenate(np.divmod(code[uses != 2], n))] = True
    own = Collapser(places, faces, locked, settings, part)
    own.run()
    patch = rows["patch"].combine_chunks().take(pa.array(np.searchsorted(number, np.arange(own.parts))))
    of = part[own.faces[:, 0]]
    yield _rows("triangle", patch.take(pa.array(of)), [cells[own.faces[:, k]] for k in range(3)], [own.points[own.faces[:, k]] for k in range(3)], own.bounds[of])
    if with_vertices:
        stands = own.survivors()
        yield _rows("vertex", patch.take(pa.array(part)), [cells, cells[stands]], [own.points[stands]], own.bounds[part])


def _streamed(settings: Settings, with_vertices: bool, rows_at_once: int = ROWS_AT_ONCE):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, len(batch), rows_at_once):
                held.append(batch.slice(a, rows_at_once))
                # The last patch may go on in the rows that follow.
                if sum(map(len, held)) >= rows_at_once:
                    table = pa.Table.from_batches(held)
                    number = _numbers(table)
                    if whole := int(np.searchsorted(number, number[-1])):
                        yield from _decimated(table.slice(0, whole), settings, with_vertices)
                    held = table.slice(whole).to_batches()
        if held:
            yield from _decimated(pa.Table.from_batches(held), settings, with_vertices)

    return work


def worked(triangles: DataFrame, vertices: DataFrame, settings: Settings | None = None, max_triangles: int = MOST_TRIANGLES, with_vertices: bool = True) -> DataFrame:
    """Rows of both kinds, see triangles_of and representatives_of; a table to keep if both are wanted. Without vertices, those of triangles alone."""
    settings = settings or Settings()
    base = cut(triangles.select(F.col("patch").cast("long").alias("patch"), *[F.col(c).cast("long").alias(c) for c in ("c0", "c1", "c2")]), max_triangles)
    corners = base.select("patch", "piece", F.explode(F.array("c0", "c1", "c2")).alias("cell")).distinct()
    corners = corners.withColumn("locked", F.count("*").over(Window.partitionBy("cell")) > 1)
    own = vertices.select(F.col("cell").cast("long").alias("cell"), *[F.col(k).cast("double").alias(k) for k in "xyz"], F.lit(True).alias("there"))
    missing = F.raise_error(F.concat(F.lit("a triangle names a vertex that is not there: "), F.coalesce(F.col("cell").cast("string"), F.lit("null")))).cast("double")
    placed = corners.join(own, "cell", "left").select("patch", "piece", F.lit(False).alias("face"), F.col("cell").alias("c0"), *[F.lit(None).cast("long").alias(c) for c in ("c1", "c2")], F.when(F.col("there"), F.col("x")).otherwise(missing).alias("x"), "y", "z", "locked")
    faces = base.select("patch", "piece", F.lit(True).alias("face"), "c0", "c1", "c2", *[F.lit(None).cast("double").alias(k) for k in "xyz"], F.lit(False).alias("locked"))
    rows = placed.unionByName(faces).repartition("patch", "piece").sortWithinPartitions("patch", "piece")
    return rows.mapInArrow(_streamed(settings, with_vertices), DONE)


def triangles_of(done: DataFrame) -> DataFrame:
    """The decimated patches' triangles with their corners' places, and each piece's plane bound."""
    return done.where("kind = 'triangle'").drop("kind")


def representatives_of(done: DataFrame) -> DataFrame:
    """Columns patch, cell, keeper, x, y, z: the vertex that stands for each vertex of before, and where it is."""
    return done.where("kind = 'vertex'").select("patch", F.col("c0").alias("cell"), F.col("c1").alias("keeper"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z"))


def decimate(triangles: DataFrame, vertices: DataFrame, settings: Settings | None = None, max_triangles: int = MOST_TRIANGLES) -> DataFrame:
    """The decimated patches' triangles (see triangles_of) of triangles (patch, c0, c1, c2) and vertices (cell, x, y, z)."""
    return triangles_of(worked(triangles, vertices, settings, max_triangles, with_vertices=False))


def seam_ledger(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: boundary edges lost and new, shared cells that lie in different places, and whether seams are clean.

    before has c0, c1, c2; after is of triangles_of.
    """
    diff = surface.seam_diff(mesh.boundary_edges(before.select("c0", "c1", "c2")), mesh.boundary_edges(after.select("c0", "c1", "c2")))
    corners = after.select(F.explode(F.array(*[F.struct(F.col(f"c{k}").alias("cell"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"), F.col(f"z{k}").alias("z")) for k in range(3)])).alias("p")).select("p.*")
    conflicts = surface.position_conflicts(corners, "cell").agg(F.count("*").alias("conflicts"))
    counts = diff.agg(F.count_if(F.col("side") == "lost").alias("lost"), F.count_if(F.col("side") == "new").alias("new"))
    return counts.join(conflicts).withColumn("clean", (F.col("lost") == 0) & (F.col("new") == 0) & (F.col("conflicts") == 0))
