"""Neighbourhood operators on a lattice of samples: one scatter, one shuffle, no join.

A scan has station_id, row, col, rng and sample_id. A sample sends its range
to the eight cells around it and to its own, and each cell then judges itself
from what arrived. The key is (station_id, row, col), so cells are spread
evenly however dense a station is. Cells must be unique: dedupe_last first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["station_id", "row", "col"]
#: The eight neighbours of a cell and the cell itself.
OFFSETS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


def dedupe_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the last one by order; ties beyond order are the caller's to avoid."""
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def scattered(scan: DataFrame, cols: int, wrap: bool, payload: Column) -> DataFrame:
    """For each cell that is present its own payload (self) and its neighbours' (around)."""
    offsets = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in OFFSETS])
    sent = scan.select("station_id", "row", "col", payload.alias("payload"), F.explode(offsets).alias("o"))
    col = F.col("col") + F.col("o.dc")
    target = sent.select(
        "station_id",
        (F.col("row") + F.col("o.dr")).alias("row"),
        (F.pmod(col, F.lit(cols)) if wrap else col).alias("col"),
        "payload",
        ((F.col("o.dr") == 0) & (F.col("o.dc") == 0)).alias("own"),
    )
    if not wrap:
        target = target.where((F.col("col") >= 0) & (F.col("col") < cols))
    gathered = target.groupBy(*CELL).agg(
        F.max(F.when(F.col("own"), F.col("payload"))).alias("self"),
        F.collect_list(F.when(~F.col("own"), F.col("payload"))).alias("around"),
    )
    return gathered.where("self is not null")


def _agrees(other: Column, own: Column, tol_abs: float, tol_rel: float) -> Column:
    return F.abs(other - own) <= F.lit(tol_abs) + F.lit(tol_rel) * own


def despeckle(scan: DataFrame, cols: int, wrap: bool, tol_abs: float = 0.02, tol_rel: float = 0.006, min_support: int = 2) -> DataFrame:
    """Columns station_id, row, col, rng, available, support, keep.

    A sample goes if enough neighbours are there and too few agree with it;
    the tolerance is that of the sample itself, so agreement is not mutual.
    """
    cells = scattered(scan, cols, wrap, F.col("rng"))
    judged = cells.select(
        *CELL,
        F.col("self").alias("rng"),
        F.size("around").alias("available"),
        F.size(F.filter("around", lambda n: _agrees(n, F.col("self"), tol_abs, tol_rel))).alias("support"),
    )
    return judged.withColumn("keep", ~((F.col("available") >= min_support) & (F.col("support") < min_support)))


def restore(carved: DataFrame, cols: int, wrap: bool, tol_abs: float = 0.02, tol_rel: float = 0.006, min_support: int = 5) -> DataFrame:
    """Columns station_id, row, col, rng, dropped, restored of a scan with a dropped flag.

    One pass over the verdict as it came in: a dropped sample comes back if
    enough neighbours that were not dropped agree with it.
    """
    cells = scattered(carved, cols, wrap, F.struct(F.col("rng"), F.col("dropped")))
    support = F.size(F.filter("around", lambda n: ~n["dropped"] & _agrees(n["rng"], F.col("self.rng"), tol_abs, tol_rel)))
    return cells.select(*CELL, F.col("self.rng").alias("rng"), F.col("self.dropped").alias("dropped"), (F.col("self.dropped") & (support >= min_support)).alias("restored"))
