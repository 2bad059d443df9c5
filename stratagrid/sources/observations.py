"""The samples that a mesh keeps, as a table ordered by lattice row, read by windows of rows or in a given order.

Directions are those of the lattice, not of the rounded positions. Files are
dealt by ranges of rows and sorted within, so a window of rows reads the files
and row groups that hold it. ordinal numbers the rows in that order, from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.operators import sampling
from stratagrid.operators.station import Lattice, turned

COLUMNS = ["ordinal", "sample_id", "row", "col", "range", "azimuth", "elevation", "x", "y", "z", "disposition"]
#: Numbers of dispositions in a store. Fixed values.
NUMBERS = {"retained": 1, "dropped_despeckle": 2, "dropped_mover_carve": 3, "dropped_island": 4, "dropped_other": 5}


def observations(samples: DataFrame, lattice: Lattice, rotation: list[list[float]] | None = None) -> DataFrame:
    """Rows of a store from a station's judged samples (cell, sample_id, row, col, x, y, z, rng, disposition): those retained, turned into the project's axes."""
    place = [F.col(k).cast("double") for k in "xyz"]
    place = turned(place, rotation) if rotation is not None else place
    kept = samples.where("disposition = 'retained'")
    rng = F.col("rng") if "rng" in samples.columns else F.sqrt(sum((F.col(k).cast("double") ** 2 for k in "xyz"), F.lit(0.0)))
    number = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    rows = kept.select(
        "cell", "sample_id", "row", "col", rng.cast("float").alias("range"), (F.col("col") * lattice.az_step + lattice.az0).cast("float").alias("azimuth"), (F.col("row") * lattice.el_step + lattice.el0).cast("float").alias("elevation"),
        *[p.cast("float").alias(k) for p, k in zip(place, "xyz", strict=True)], F.element_at(number, F.col("disposition")).cast("tinyint").alias("disposition"),
    )
    return sampling.dense_rank(rows, "cell", "ordinal").select(COLUMNS)


def write(rows: DataFrame, path: str) -> None:
    """Writes a store; a store that is there already raises."""
    rows.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole store; ordinals that are not all numbers from 0 raise."""
    rows = spark.read.parquet(path)
    facts = rows.agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("d"), F.max("ordinal").alias("last")).first()
    if facts["n"] != facts["d"] or (facts["n"] and facts["last"] != facts["n"] - 1):
        raise ValueError(f"{path}: observations are missing or there twice")
    return rows


def row_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Places of the observations of lattice rows low to high, both of them in; the rest of the files is not read."""
    return rows.where(F.col("row").between(low, high)).select("ordinal", "row", "x", "y", "z")


def row_index(rows: DataFrame) -> DataFrame:
    """Columns row, first, count: where each lattice row's observations begin and how many there are."""
    return rows.groupBy("row").agg(F.min("ordinal").alias("first"), F.count("*").alias("count"))


def gather(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (request, ordinal) with row, x, y, z of each, repeats and all, by request; an ordinal that is not there raises."""
    found = wanted.select("request", "ordinal").join(rows.select("ordinal", "row", "x", "y", "z"), "ordinal", "left")
    missing = F.raise_error(F.concat(F.lit("no observation "), F.col("ordinal").cast("string"))).cast("int")
    return found.withColumn("row", F.when(F.col("row").isNotNull(), F.col("row")).otherwise(missing)).select("request", "ordinal", "row", "x", "y", "z").orderBy("request")
