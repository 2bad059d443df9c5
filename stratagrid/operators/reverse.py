"""From the mesh back to its samples: points drawn on triangles, measured to the nearest sample of nearby rows.

Triangles (c0, c1, c2 sample ids, area, and corners p0, p1, p2) of positive
area are put in canonical order: each triple is turned so that its least id
comes first, and triples ascend. n even targets along the running area choose
triangles; where a target's point lies in its triangle follows from a SHA-256
of a domain, the seed, the triple and the target's number, so a point depends
on what it is and not on when it was drawn. Ranks, targets and digests are
column expressions; no task sees all triangles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.operators import qa, reports, sampling

#: What the digests of our points begin with. A fixed value.
DOMAIN = b"stratagrid-reverse-1"
#: Rows around a triangle's own that a nearest sample may be in.
WINDOW_ROWS = 8
LEAST_POINTS = 10_000


def low_end_hex(number: Column) -> Column:
    """A long's eight bytes in hex, the lowest first."""
    whole = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.concat(*[F.substring(whole, 15 - 2 * k, 2) for k in range(8)])


def unit(digest: Column, place: int) -> Column:
    """Eight bytes of a hex digest, the lowest first, as a number between 0 and 1."""
    part = F.concat(*[F.substring(digest, 16 * place + 15 - 2 * k, 2) for k in range(8)])
    return (F.conv(part, 16, 10).cast("decimal(20,0)").cast("double") + 0.5) / 2.0**64


def interior(triple: list[Column], target: Column, seed: int = 0, domain: bytes = DOMAIN) -> tuple[Column, Column, Column]:
    """The weights of a triangle's corners at its target's point; they are positive and add up to one."""
    packed = F.concat(F.lit(domain.hex()), *[low_end_hex(c) for c in (F.lit(seed), *triple, target)])
    digest = F.sha2(F.unhex(packed), 256)
    root, other = F.sqrt(unit(digest, 0)), unit(digest, 1)
    return 1 - root, root * (1 - other), root * other


def canonical(triangles: DataFrame) -> DataFrame:
    """Triangles of positive area turned so that the least id comes first; corners turn with them, winding stays."""
    ends = [F.struct(F.col(f"c{k}").alias("c"), F.col(f"p{k}").alias("p")) for k in range(3)]
    turns = [F.array(*[ends[(k + j) % 3] for j in range(3)]) for k in range(3)]
    least = F.least("c0", "c1", "c2")
    turned = F.when(F.col("c0") == least, turns[0]).when(F.col("c1") == least, turns[1]).otherwise(turns[2])
    rest = [c for c in triangles.columns if c not in {"c0", "c1", "c2", "p0", "p1", "p2"}]
    own = triangles.where("area > 0").select(*rest, turned.alias("t"))
    return own.select(*rest, *[F.col("t")[k][n].alias(f"{n}{k}") for k in range(3) for n in ("c", "p")])


def points_wanted(triangles: int, most: int) -> int:
    """As many points as triangles, LEAST_POINTS at least, most at most."""
    return min(most, max(triangles, min(LEAST_POINTS, most)))


def selected(triangles: DataFrame, n: int) -> DataFrame:
    """Columns target and those of the canonical triangle that each of n targets along the running area falls on."""
    own = canonical(triangles).withColumn("key", F.struct("c0", "c1", "c2"))
    # Areas are 32-bit, so as decimals their sums are exact in any order.
    weighted = own.select("key", F.col("area").cast("float").cast("double").cast("decimal(28,14)").alias("weight"))
    return sampling.systematic(weighted, "key", "weight", n).join(own, "key").drop("key")


def drawn(triangles: DataFrame, n: int, seed: int = 0, domain: bytes = DOMAIN) -> DataFrame:
    """Columns target, c0, c1, c2, x, y, z (and other columns of the triangles): n points on the surface."""
    chosen = selected(triangles, n)
    weights = interior([F.col(f"c{k}") for k in range(3)], F.col("target"), seed, domain)
    place = [sum((w * F.col(f"p{k}")[axis] for k, w in enumerate(weights)), F.lit(0.0)).alias(axis) for axis in "xyz"]
    return chosen.select(*[c for c in chosen.columns if c not in {"p0", "p1", "p2"}], *place)


@dataclass(frozen=True)
class Reverse:
    """distances: target, distance (null where no sample is in the rows); report: one row."""

    distances: DataFrame
    report: DataFrame


def reverse_report(triangles: DataFrame, samples: DataFrame, most: int = 500_000, window_rows: int | None = WINDOW_ROWS, seed: int = 0, near: float = 0.002, far: float = 0.005, span: float | None = None) -> Reverse:
    """How far points of the surface are from the nearest sample (cell, row, x, y, z) within window_rows of their triangle's rows.

    triangles also have low and high, the rows of their corners. Points without
    a sample in their rows are counted as unmatched and in no figure.
    window_rows of None looks at all samples.
    """
    count = triangles.where("area > 0").count()
    n = points_wanted(count, most) if count and most > 0 else 0
    points = drawn(triangles, n, seed).select(F.col("target").alias("sample_id"), "x", "y", "z", *([(F.col("low") - window_rows).alias("low"), (F.col("high") + window_rows).alias("high")] if window_rows is not None else []))
    points = points.checkpoint() if n else points.limit(0)
    found = qa.nearest_vertices(points, samples, span, 1).select("sample_id", "distance")
    distances = points.select("sample_id").join(found, "sample_id", "left").select(F.col("sample_id").alias("target"), "distance")
    matched = reports.deviation(distances.where("distance is not null"), "distance", near, far)
    counts = distances.agg(F.count("*").alias("selected"), F.count_if(F.col("distance").isNull()).alias("unmatched"))
    return Reverse(distances, matched.join(counts).withColumn("triangles", F.lit(count).cast("long")))


def ties(nearest: DataFrame, k: int) -> DataFrame:
    """One row: the samples whose last two of k distances are equal, so that which vertex counts is a matter of ids."""
    own = nearest.groupBy("sample_id").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("a"), F.max(F.when(F.col("rank") == k - 1, F.col("distance"))).alias("b"))
    return own.agg(F.count_if(F.col("a") == F.col("b")).alias("ties"), F.count("*").alias("samples"))


def calibration(bounded: DataFrame, free: DataFrame) -> DataFrame:
    """One row: how far distances bound to rows are from those to all samples (target, distance each)."""
    both = bounded.select("target", F.col("distance").alias("b")).join(free.select("target", F.col("distance").alias("f")), "target").where("b is not null and f is not null")
    gap = F.col("b") - F.col("f")
    return both.agg(F.count("*").alias("n"), F.avg((gap == 0).cast("int")).alias("identical"), F.max(gap).alias("largest"), F.min(gap).alias("least"))


def ambiguous_facing(facing: Column, normal_size: Column, view_size: Column) -> Column:
    """Whether a normal is edge-on to the view, within rounding."""
    return F.abs(facing) <= 1e-12 * normal_size * view_size
