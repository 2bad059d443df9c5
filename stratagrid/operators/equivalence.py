"""Whether two meshes, ledgers or reports are the same, by the strictness that each part can have.

rows: equal to the bit, in any order. triangles: the same oriented triples,
each as often, wherever a triple begins. normals: unit and within an angle.
Every check gives one row with what differs and an example, so it can be
written beside the tables; require raises if any does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.functions.geometry import cross, dot, norm
from stratagrid.operators import mesh, surface

FOUND = "part string, tier string, differing long, largest double, example string"


def _bits(rows: DataFrame) -> DataFrame:
    """Numbers as their bits, so that -0.0 is not 0.0 and a NaN is itself."""
    exact = ("double", "float")
    return rows.select(*[F.struct(F.col(c).alias("v"), ((F.col(c).cast("string") == "-0.0") if rows.schema[c].dataType.typeName() in exact else F.lit(False)).alias("s")).alias(c) for c in rows.columns])


def _result(part: str, tier: str, wrong: DataFrame, largest: Column | None = None, example: Column | None = None) -> DataFrame:
    return wrong.agg(F.count("*").alias("differing"), (F.max(largest) if largest is not None else F.lit(None).cast("double")).alias("largest"), F.min(example if example is not None else F.to_json(F.struct(*wrong.columns))).alias("example")).select(F.lit(part).alias("part"), F.lit(tier).alias("tier"), "differing", F.col("largest").cast("double").alias("largest"), "example")


def rows(part: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either that the other does not have as often; another schema is a difference."""
    if left.dtypes != right.dtypes:
        text = f"{left.dtypes} and {right.dtypes}"
        return left.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit("bits").alias("tier"), F.lit(1).cast("long").alias("differing"), F.lit(None).cast("double").alias("largest"), F.lit(text).alias("example"))
    wrong = surface.multiset_diff(_bits(left), _bits(right))
    return _result(part, "bits", wrong)


def oriented(triangles: DataFrame) -> DataFrame:
    """Columns a, b, c, turned: triples begun at their least id, and whether that turned them; winding stays."""
    a, b, c = mesh.canonical_triple(F.col("c0"), F.col("c1"), F.col("c2"))
    return triangles.select(a.alias("a"), b.alias("b"), c.alias("c"), (a != F.col("c0")).alias("turned"))


def triangles(part: str, left: DataFrame, right: DataFrame) -> DataFrame:
    wrong = surface.multiset_diff(oriented(left).drop("turned"), oriented(right).drop("turned"))
    return _result(part, "triples", wrong)


def normals(part: str, left: DataFrame, right: DataFrame, most: float = 1e-6) -> DataFrame:
    """Vertices (cell, nx, ny, nz) that only one has, whose normal is not of length 1 or 0, or differs by more than an angle (radians)."""
    name = lambda t, s: t.select("cell", F.struct(F.col("nx").cast("double").alias("x"), F.col("ny").cast("double").alias("y"), F.col("nz").cast("double").alias("z")).alias(s))
    both = name(left, "l").join(name(right, "r"), "cell", "full")
    p, q = (tuple(F.col(f"{s}.{k}") for k in "xyz") for s in "lr")
    angle = F.atan2(norm(cross(p, q)), dot(p, q))
    sized = lambda v: (F.abs(norm(v) - 1) <= 1e-6) | (norm(v) == 0)
    fine = F.coalesce(sized(p) & sized(q) & ((norm(p) == 0) == (norm(q) == 0)) & (angle <= most), F.lit(False))
    return _result(part, "angle", both.where(~fine), angle, F.col("cell").cast("string"))


def ledgers(part: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Ledgers must balance as well as be equal."""
    wrong = rows(part, left, right)
    unbalanced = left.unionByName(right).where("not balanced").agg(F.count("*").alias("u"))
    return wrong.join(unbalanced).select("part", F.lit("ledger").alias("tier"), (F.col("differing") + F.col("u")).alias("differing"), "largest", "example")


def require(checks: list[DataFrame]) -> DataFrame:
    """All checks' rows; the first that differs raises with its example."""
    every = reduce(DataFrame.unionByName, checks)
    wrong = every.where("differing > 0").orderBy("part").first()
    if wrong is not None:
        raise AssertionError(f"{wrong['part']} ({wrong['tier']}): {wrong['differing']} differ, such as {wrong['example']}")
    return every


def stations(left, right) -> list[DataFrame]:
    """The checks of two station.Meshed."""
    key = ["station_id", "sample_id", "disposition", "restored"]
    return [
        rows("samples", left.samples.select(key), right.samples.select(key)),
        triangles("triangles", left.triangles, right.triangles),
        normals("normals", *[m.samples.where("disposition = 'retained'") for m in (left, right)]),
        ledgers("ledger", left.ledger, right.ledger),
    ]
