"""Measures of a triangle mesh: normals, plane quadrics, dihedral angles, seams.

Triangles have c0, c1, c2 (vertex ids in their winding order); vertices have
cell, x, y, z. Every operator is a few equi joins and aggregations on vertex
or edge keys, partial sums first. A triangle with a vertex that the vertex
table lacks raises; a degenerate one has no normal and counts in none of the
sums of normals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.functions.geometry import cross, dot, minus, norm
from stratagrid.operators.sampling import percentiles
from stratagrid.session import shared_folder

CORNERS = ("c0", "c1", "c2")
#: The coefficients of a plane's quadric, upper triangle of the product of (a, b, c, d) with itself.
QUADRIC = ("aa", "ab", "ac", "ad", "bb", "bc", "bd", "cc", "cd", "dd")


def _point(name: str) -> tuple[Column, Column, Column]:
    return F.col(f"{name}.x"), F.col(f"{name}.y"), F.col(f"{name}.z")


def placed(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with columns p0, p1, p2, the structs (x, y, z) of their corners; a vertex that is not there raises."""
    out = triangles
    for k, name in enumerate(CORNERS):
        own = vertices.select(F.col("cell").alias(name), F.struct("x", "y", "z").alias(f"p{k}"))
        missing = F.raise_error(F.concat(F.lit("a triangle names a vertex that is not there: "), F.col(name).cast("string")))
        joined = out.join(own, name, "left")
        out = joined.withColumn(f"p{k}", F.when(F.col(f"p{k}").isNotNull(), F.col(f"p{k}")).otherwise(missing.cast(own.schema[f"p{k}"].dataType)))
    return out


def faces(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Columns c0, c1, c2, area, p0 and n, the unit normal (x, y, z), null for degenerate triangles."""
    base = placed(triangles.select(*CORNERS), vertices)
    p, q, r = (_point(f"p{k}") for k in range(3))
    across = base.select(*CORNERS, "p0", F.struct(*[c.alias(k) for c, k in zip(cross(minus(q, p), minus(r, p)), "xyz", strict=True)]).alias("x"))
    sized = across.withColumn("size", norm(_point("x")))
    unit = F.when(F.col("size") > 0, F.struct(*[(F.col(f"x.{k}") / F.col("size")).alias(k) for k in "xyz"]))
    return sized.select(*CORNERS, (F.col("size") / 2).alias("area"), "p0", unit.alias("n"))


def _per_vertex(found: DataFrame, *keep: str) -> DataFrame:
    return found.select(F.explode(F.array(*CORNERS)).alias("cell"), *keep)


def vertex_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Columns cell, nx, ny, nz: unit sums of the faces' normals, weighted by area; 0 where they cancel."""
    own = faces(triangles, vertices).where("n is not null")
    rows = _per_vertex(own.select(*CORNERS, *[(F.col("area") * F.col(f"n.{k}")).alias(k) for k in "xyz"]), *"xyz")
    sums = rows.groupBy("cell").agg(*[F.sum(k).alias(k) for k in "xyz"])
    size = norm((F.col("x"), F.col("y"), F.col("z")))
    return sums.select("cell", *[F.when(size > 0, F.col(k) / size).otherwise(0.0).alias(f"n{k}") for k in "xyz"])


def plane_quadrics(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """For each vertex the sums of its faces' plane quadrics, each weighted by its area, and the least of these areas."""
    own = faces(triangles, vertices).where("n is not null")
    plane = own.select(*CORNERS, "area", F.col("n.x").alias("a"), F.col("n.y").alias("b"), F.col("n.z").alias("c"), (-dot(_point("n"), _point("p0"))).alias("d"))
    rows = _per_vertex(plane, "a", "b", "c", "d", "area")
    return rows.groupBy("cell").agg(*[F.sum(F.col("area") * F.col(k[0]) * F.col(k[1])).alias(k) for k in QUADRIC], F.min("area").alias("min_face_area"))


def quadric_error(x: Column, y: Column, z: Column) -> Column:
    """The quadric of a row's columns at a point: the sum of squared distances from its planes, each times its face's area."""
    v = {"a": x, "b": y, "c": z, "d": F.lit(1.0)}
    return sum((F.lit(1.0 if k[0] == k[1] else 2.0) * F.col(k) * v[k[0]] * v[k[1]] for k in QUADRIC), F.lit(0.0))


def area_stats(triangles: DataFrame) -> DataFrame:
    """One row: triangles, area, least positive and largest area, and exact: whether sums don't depend on order.

    Areas are 32-bit and summed in 64 bits; as long as the total is below
    2**29 times the least positive area, no sum rounds.
    """
    one = F.col("area").cast("float").cast("double")
    sums = triangles.agg(F.count("*").alias("n"), F.sum(one).alias("total"), F.min(F.when(one > 0, one)).alias("least"), F.max(one).alias("largest"))
    ratio = F.try_divide("total", "least")
    return sums.select("n", "total", "least", "largest", ratio.alias("ratio"), F.coalesce(ratio < 2.0**29, F.lit(True)).alias("exact"))


def plane_bound(x: Column, y: Column, z: Column) -> Column:
    """A bound of the point's distance from each of the planes in a row's quadric."""
    return F.sqrt(F.greatest(quadric_error(x, y, z), F.lit(0.0)) / F.col("min_face_area"))


def dihedrals(triangles: DataFrame, vertices: DataFrame, owner: Column | None = None) -> DataFrame:
    """Columns e0, e1, angle (degrees between the normals), for edges of exactly two faces with normals.

    Faces are grouped by edge, not joined with themselves: the least and the
    largest of two normals are both, so an edge of many faces makes no pairs.
    owner: a column of c0, c1, c2 that says whose a triangle is; with it there
    is a column across, whether the two faces have different owners.
    """
    own = faces(triangles, vertices).where("n is not null").withColumn("owner", owner if owner is not None else F.lit(0))
    sides = F.array(*[F.struct(F.least(p, q).alias("e0"), F.greatest(p, q).alias("e1")) for p, q in (("c0", "c1"), ("c1", "c2"), ("c2", "c0"))])
    rows = own.select(F.explode(sides).alias("e"), "n", "owner").select("e.e0", "e.e1", "n", "owner")
    ends = rows.groupBy("e0", "e1").agg(F.count("*").alias("uses"), F.min("n").alias("p"), F.max("n").alias("q"), F.min("owner").alias("a"), F.max("owner").alias("b")).where("uses = 2")
    p, q = _point("p"), _point("q")
    found = ends.select("e0", "e1", F.degrees(F.atan2(norm(cross(p, q)), dot(p, q))).alias("angle"), (F.col("a") != F.col("b")).alias("across"))
    return found if owner is not None else found.drop("across")


def dihedral_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns across, n_before, n_after and for mean, p99 and maximum the ratio of after to before, where across tells seams from the inside."""
    figures = ("mean", "p99", "maximum")
    one = lambda rows, side: dihedral_stats(rows, ["across"]).select("across", F.col("n").alias(f"n_{side}"), *[F.col(f).alias(f"{f}_{side}") for f in figures])
    both = one(before, "before").join(one(after, "after"), "across", "full")
    return both.select("across", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"), *[F.try_divide(f"{f}_after", f"{f}_before").alias(f"{f}_ratio") for f in figures])


def dihedral_stats(angles: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Count, mean, median, 99th percentile and maximum, and how many are over one and five degrees.

    Without groups percentiles come from ranks over ranges; a group's are exact
    percentiles of its task, so groups should be tiles, not the whole mesh.
    """
    if not group:
        shared_folder(angles.sparkSession)
        kept = angles.select("angle").checkpoint()
        median, p99 = percentiles(kept, "angle", [0.5, 0.99])
        return kept.agg(F.count("*").alias("n"), F.avg("angle").alias("mean"), F.lit(median).cast("double").alias("median"), F.lit(p99).cast("double").alias("p99"), F.max("angle").alias("maximum"), F.count_if(F.col("angle") > 1).alias("over_1"), F.count_if(F.col("angle") > 5).alias("over_5"))
    return angles.groupBy(*(group or [])).agg(
        F.count("*").alias("n"),
        F.avg("angle").alias("mean"),
        F.percentile("angle", 0.5).alias("median"),
        F.percentile("angle", 0.99).alias("p99"),
        F.max("angle").alias("maximum"),
        F.count_if(F.col("angle") > 1).alias("over_1"),
        F.count_if(F.col("angle") > 5).alias("over_5"),
    )


def seam_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns e0, e1, side: boundary edges that only one of two meshes has."""
    changed = multiset_diff(before.select("e0", "e1"), after)
    side = F.when(F.col("surplus") > 0, "lost").otherwise("new")
    return changed.select("e0", "e1", F.explode(F.array_repeat(side, F.abs("surplus").cast("int"))).alias("side"))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with the surplus of left over right (negative: of right), by counts of equal rows."""
    names = left.columns
    both = left.withColumn("surplus", F.lit(1)).unionByName(right.select(names).withColumn("surplus", F.lit(-1)))
    return both.groupBy(*names).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def position_conflicts(vertices: DataFrame, key: str = "cell") -> DataFrame:
    """Keys whose rows differ in x, y or z, with the number of different positions."""
    # One row a position first, so a key that a third of all rows have stays small.
    return vertices.select(key, "x", "y", "z").distinct().groupBy(key).agg(F.count("*").alias("positions")).where("positions > 1")


def ground_occupancy(points: DataFrame, cell: float) -> DataFrame:
    """One row: the ground cells in use, and the largest, total and mean number of points in one."""
    held = points.groupBy(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")).agg(F.count("*").alias("n"))
    return held.agg(F.count("*").alias("cells"), F.max("n").alias("largest"), F.sum("n").alias("total"), F.avg("n").alias("mean"))
