"""Coarse range grids of stations and what neighbouring stations saw.

A grid is sparse: a bin without a row holds no evidence.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.operators.qa import nearest_vertices
from stratagrid.operators.stencil import OFFSETS


def direction_bin(x: Column, y: Column, z: Column, width: int, height: int) -> tuple[Column, Column]:
    """Bin of a direction: azimuth wraps, elevation is clipped."""
    rng = F.sqrt(x * x + y * y + z * z)
    azimuth = F.atan2(y, x)
    elevation = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / rng)))
    u = F.pmod(((azimuth + math.pi) / (2 * math.pi) * width).cast("long"), F.lit(width))
    v = F.least(F.greatest(((elevation + math.pi / 2) / math.pi * height).cast("long"), F.lit(0)), F.lit(height - 1))
    return u, v


def range_grid(samples: DataFrame, keys: list[str], rng: str = "rng") -> DataFrame:
    """The least range of each bin, samples at the scanner left out."""
    return samples.where(F.col(rng) > 1e-6).groupBy(*keys).agg(F.min(rng).alias("r"))


def close_holes(grid: DataFrame, width: int, height: int) -> DataFrame:
    """Fills each empty bin with the least of its neighbours, once; columns wrap, rows don't."""
    offsets = F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a, b in OFFSETS])
    sent = grid.select("u", "v", "r", F.explode(offsets).alias("o")).select(
        F.pmod(F.col("u") + F.col("o.du"), F.lit(width)).alias("u"),
        (F.col("v") + F.col("o.dv")).alias("v"),
        "r",
        ((F.col("o.du") == 0) & (F.col("o.dv") == 0)).alias("own"),
    )
    merged = sent.where((F.col("v") >= 0) & (F.col("v") < height)).groupBy("u", "v").agg(F.min(F.when(F.col("own"), F.col("r"))).alias("own"), F.min("r").alias("any"))
    return merged.select("u", "v", F.coalesce("own", "any").alias("r"), F.col("own").isNull().alias("filled"))


def seen_through(samples: DataFrame, grid: DataFrame, clear_margin: float = 0.4, relative_margin: float = 1.02) -> DataFrame:
    """samples (u, v, rng, ...) with seen: whether the grid saw clearly beyond them."""
    beyond = (F.col("r") > F.col("rng") + clear_margin) & (F.col("r") > F.lit(relative_margin) * F.col("rng"))
    return samples.join(grid, ["u", "v"], "left").withColumn("seen", F.coalesce(beyond, F.lit(False))).drop("r")


def carve(samples: DataFrame, grids: list[DataFrame], min_votes: int = 1, clear_margin: float = 0.4, relative_margin: float = 1.02) -> DataFrame:
    """samples with votes (the grids that saw beyond) and dropped; without grids nothing is dropped.

    The grids are brought together by bin first, so samples are joined once.
    """
    if not grids:
        return samples.withColumn("votes", F.lit(0)).withColumn("dropped", F.lit(False))
    every = reduce(DataFrame.unionByName, [g.select("u", "v", "r") for g in grids])
    bins = every.groupBy("u", "v").agg(F.collect_list("r").alias("_seen"))
    beyond = lambda r: (r > F.col("rng") + clear_margin) & (r > F.lit(relative_margin) * F.col("rng"))
    votes = F.coalesce(F.size(F.filter("_seen", beyond)), F.lit(0))
    voted = samples.join(bins, ["u", "v"], "left").withColumn("votes", F.when(F.col("_seen").isNull(), 0).otherwise(votes)).drop("_seen")
    return voted.withColumn("dropped", F.col("votes") >= max(1, min(min_votes, len(grids))))


def select_neighbours(stations: DataFrame, key: str, position: list[str], k: int) -> DataFrame:
    """Columns station, neighbour, rank, distance: the k stations nearest to each, by where their scanners were.

    Distances are those of the position's columns (up to three), at any
    distance, ties to the smaller key. Keys are numbers, one row each; stations
    with a null in their position take no part.
    """
    axes = [F.col(c).cast("double") for c in position] + [F.lit(0.0)] * (3 - len(position))
    own = stations.select(F.col(key).cast("long").alias("sample_id"), *[c.alias(n) for c, n in zip(axes, "xyz", strict=True)]).where("sample_id is not null")
    # A station is nearest to itself, so there is one more than is asked for, unless k + 1 others are in its place.
    found = nearest_vertices(own, own.withColumnRenamed("sample_id", "cell"), k=k + 1).where("cell <> sample_id")
    order = Window.partitionBy("sample_id").orderBy("rank")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("sample_id").alias("station"), F.col("cell").alias("neighbour"), "rank", "distance")
