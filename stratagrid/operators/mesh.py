"""Triangles from lattice quads, and aggregates over triangles.

Vertices are cells, numbered row * cols + col. Triangles have c0, c1, c2 in
their winding order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The corners of a quad by their offset from the first.
CORNERS = {"a": (0, 0), "b": (0, 1), "c": (1, 0), "d": (1, 1)}
#: Cells of the lattice rows that a task triangulates at once.
BAND_CELLS = 1 << 16
#: The triangles of a quad in their winding order.
WAYS = ("acb", "bcd", "acd", "adb")


def _length(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    x, y, z = p - q
    return np.sqrt(x * x + y * y + z * z)


def _area(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Half the length of the cross product of two edges."""
    (ax, ay, az), (bx, by, bz) = q - p, r - p
    x, y, z = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    return 0.5 * np.sqrt(x * x + y * y + z * z)


def _quads(rows: np.ndarray, cols: np.ndarray, across: int, wrap: bool) -> dict[str, np.ndarray]:
    """For each quad that a sample is a corner of the samples at its corners, -1 where there is none; samples come sorted by place."""
    at = rows * across + cols
    parts = []
    for dr, dc in CORNERS.values():
        r, c = rows - dr, cols - dc
        inside = r >= 0
        if wrap:
            c = c % across
        else:
            inside &= (c >= 0) & (c < across - 1)
        parts.append((r * across + c)[inside])
    quads = np.unique(np.concatenate(parts))
    found = {"first_row": quads // across}
    for name, (dr, dc) in CORNERS.items():
        col = quads % across + dc
        want = (quads // across + dr) * across + (col % across if wrap else col)
        place = np.minimum(np.searchsorted(at, want), len(at) - 1)
        found[name] = np.where(at[place] == want, place, -1)
    return found


def _band_triangles(band: int, band_rows: int, samples: dict[str, np.ndarray], cols: int, wrap: bool, step: float, reach: float, noise_floor: float, min_quality: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells (three columns) and areas of the triangles whose quads begin in a band's rows."""
    # Of samples in one place the one with the largest values counts, null below all numbers and NaN above.
    values = [samples[k] for k in ("cell", "rng", "x", "y", "z")]
    keys = [k for v, null in zip(values[:0:-1], [samples[f"{n}_null"] for n in "zyx"] + [samples["rng_null"]], strict=True) for k in (v, ~null)]
    order = np.lexsort([*keys, values[0], samples["col"], samples["row"]])
    row, col = samples["row"][order], samples["col"][order]
    last = np.r_[(row[1:] != row[:-1]) | (col[1:] != col[:-1]), True]
    row, col, order = row[last], col[last], order[last]
    quads = _quads(row, col, cols, wrap)
    mine = quads["first_row"] // band_rows == band
    corner = {n: quads[n][mine] for n in CORNERS}
    there = {n: k >= 0 for n, k in corner.items()}
    cell = samples["cell"][order]
    # A range that is null is no part of the largest one, one that is NaN is larger than any number.
    rng = samples["rng"][order]
    far = np.where(samples["rng_null"][order], -np.inf, np.where(np.isnan(rng), np.inf, rng))
    place = np.stack([np.where(samples[f"{k}_null"][order], np.nan, samples[k][order]) for k in "xyz"])
    at = {n: place[:, k] for n, k in corner.items()}
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        length = {p + q: _length(at[p], at[q]) for p, q in ("ab", "ac", "ad", "bc", "bd", "cd")}
        area, good = {}, {}
        for way in WAYS:
            p, q, r = names = sorted(way)
            area[way] = _area(*(at[n] for n in names))
            longest = np.maximum(np.maximum(length[p + q], length[p + r]), length[q + r])
            most = np.fmax(noise_floor, np.maximum(np.maximum(far[corner[p]], far[corner[q]]), far[corner[r]]) * step * reach)
            good[way] = there[p] & there[q] & there[r] & (longest < most) & (2 * area[way] / (longest * longest) > min_quality)
    full = there["a"] & there["b"] & there["c"] & there["d"]
    by_bc, by_ad = full & good["acb"] & good["bcd"], full & good["acd"] & good["adb"]
    by_bc &= ~by_ad | (length["bc"] <= length["ad"])
    by_ad &= ~by_bc
    # A quad with three corners has one way at most that is good.
    chosen = {way: np.flatnonzero((by_bc if way in ("acb", "bcd") else by_ad) | (~full & good[way])) for way in WAYS}
    return np.concatenate([np.stack([cell[corner[n][k]] for n in way], axis=1) for way, k in chosen.items()]), np.concatenate([area[way][k] for way, k in chosen.items()])


def triangulate(points: DataFrame, cols: int, wrap: bool, step: float, max_incidence_deg: float = 82.0, noise_floor: float = 0.012, min_quality: float = 0.015) -> DataFrame:
    """Columns c0, c1, c2, area.

    A full quad is cut along its shorter good diagonal (b-c on ties), a quad
    with three corners gives one triangle. A triangle is good if its longest
    edge is less than a surface at the steepest incidence would give and it is
    not a sliver.

    Samples are dealt to bands of lattice rows of about BAND_CELLS cells; those
    of a band's first row also go to the band before, whose last quads end
    there. A task works on the arrays of one band.
    """
    reach = math.tan(math.radians(min(max_incidence_deg, 89.5)))
    band_rows = max(1, BAND_CELLS // cols)
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    first = F.floor(row / band_rows)
    both = F.when((row % band_rows == 0) & (row > 0), F.array(first, first - 1)).otherwise(F.array(first))
    own = points.where("row >= 0 and col is not null").select(row.alias("row"), (F.pmod(col, F.lit(cols)) if wrap else col).alias("col"), (row * cols + col).alias("cell"), *[F.col(k).cast("double").alias(k) for k in ("rng", "x", "y", "z")], F.explode(both).alias("band"))
    own = own if wrap else own.where(F.col("col").between(0, cols - 1))

    def work(key, table):
        samples = {}
        for k in ("row", "col", "cell", "rng", "x", "y", "z"):
            column = table.column(k)
            if k in ("rng", "x", "y", "z"):
                samples[f"{k}_null"] = column.is_null().to_numpy()
                column = column.fill_null(0.0)
            samples[k] = column.to_numpy()
        cells, areas = _band_triangles(key[0].as_py(), band_rows, samples, cols, wrap, step, reach, noise_floor, min_quality)
        return pa.table({**{f"c{k}": pa.array(np.ascontiguousarray(cells[:, k]), pa.int64()) for k in range(3)}, "area": pa.array(areas, pa.float64())})

    return own.groupBy("band").applyInArrow(work, "c0 long, c1 long, c2 long, area double")


def edges(triangles: DataFrame) -> DataFrame:
    """The three edges of each triangle, the smaller cell first, with the opposite cell."""
    pair = lambda p, q, o: F.named_struct(F.lit("e0"), F.least(p, q), F.lit("e1"), F.greatest(p, q), F.lit("opposite"), F.col(o))
    return triangles.select(F.explode(F.array(pair("c0", "c1", "c2"), pair("c1", "c2", "c0"), pair("c2", "c0", "c1"))).alias("e")).select("e.*")


def edge_use(triangles: DataFrame) -> DataFrame:
    """How many triangles use each edge."""
    return edges(triangles).groupBy("e0", "e1").agg(F.count("*").alias("uses"))


def boundary_edges(triangles: DataFrame) -> DataFrame:
    return edge_use(triangles).where("uses = 1").select("e0", "e1")


def nonmanifold_edges(triangles: DataFrame) -> DataFrame:
    return edge_use(triangles).where("uses > 2")


def canonical_triple(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """The least rotation of a triple in lexical order; its direction stays."""
    least = F.array_min(F.array(*[F.named_struct(F.lit("a"), x, F.lit("b"), y, F.lit("c"), z) for x, y, z in ((a, b, c), (b, c, a), (c, a, b))]))
    return least["a"], least["b"], least["c"]


def component_areas(triangles: DataFrame, roots: DataFrame) -> DataFrame:
    """Triangles and area of each component; areas narrow to float first, so that sums don't depend on their order."""
    labelled = triangles.join(roots, triangles.c0 == roots.node)
    return labelled.groupBy("root").agg(F.count("*").alias("triangles"), F.sum(F.col("area").cast("float").cast("double")).alias("area"))


def cull_islands(triangles: DataFrame, roots: DataFrame, min_area: float = 0.005, min_triangles: int = 8) -> DataFrame:
    """The triangles of components that are large enough; all of them if min_area is not positive."""
    if min_area <= 0:
        return triangles
    large = component_areas(triangles, roots).where((F.col("area") >= min_area) & (F.col("triangles") >= min_triangles)).select("root")
    return triangles.join(roots, triangles.c0 == roots.node).join(large, "root", "left_semi").select(*triangles.columns)


def vertex_links(triangles: DataFrame) -> DataFrame:
    """Edges that connect the vertices of each triangle."""
    return triangles.select(F.explode(F.array(*[F.named_struct(F.lit("src"), F.col("c0"), F.lit("dst"), F.col(c)) for c in ("c1", "c2")])).alias("e")).select("e.*")
