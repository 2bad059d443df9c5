"""Facts about a station's lattice: steps, fits, and the ledger of its samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.functions.geometry import circular_gap


def median_step(values: DataFrame, key: str, value: str, least: float = 0.0) -> DataFrame:
    """For each key the median gap between neighbouring distinct values, gaps of at most least left out; no gap, no row.

    The window is per key; give a station's strided sample where one key may
    hold many rows.
    """
    order = Window.partitionBy(key).orderBy(value)
    gaps = values.select(key, value).where(F.col(value).isNotNull()).distinct().withColumn("gap", F.col(value) - F.lag(value).over(order))
    return gaps.where(F.col("gap") > least).groupBy(key).agg(F.percentile("gap", 0.5).alias("step"))


def circular_step(samples: DataFrame, rows: list[str], col: str, azimuth: str) -> DataFrame:
    """The median of azimuth per column between consecutive samples of a row; gaps wrap at half a turn."""
    order = Window.partitionBy(*rows).orderBy(col)
    gaps = samples.select((circular_gap(F.col(azimuth), F.lag(azimuth).over(order)) / (F.col(col) - F.lag(col).over(order))).alias("gap"))
    return gaps.agg(F.percentile("gap", 0.5).alias("step"))


def linear_fit(rows: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Slope, intercept and R squared of y over x; one aggregation."""
    return rows.groupBy(*(keys or [])).agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


#: Where an input sample can end, in the order in which filters look at it.
DISPOSITIONS = ("dropped_no_return", "dropped_despeckle", "dropped_mover_carve", "dropped_other", "dropped_island", "retained")


def disposition(returned: Column, kept: Column, carved: Column, meshed: Column, culled: Column) -> Column:
    """Where a sample ended: the first filter that took it, or retained."""
    return (
        F.when(~returned, "dropped_no_return")
        .when(~kept, "dropped_despeckle")
        .when(carved, "dropped_mover_carve")
        .when(~meshed, "dropped_other")
        .when(culled, "dropped_island")
        .otherwise("retained")
    )


def ledger(samples: DataFrame, keys: list[str] | None = None, name: str = "disposition") -> DataFrame:
    """Counts of all dispositions beside input_points, and balanced: whether they add up.

    A disposition that is null or unknown counts in none and unbalances it.
    """
    counts = samples.groupBy(*(keys or [])).agg(F.count("*").alias("input_points"), *[F.count_if(F.col(name) == d).alias(d) for d in DISPOSITIONS])
    return counts.withColumn("balanced", F.col("input_points") == sum((F.col(d) for d in DISPOSITIONS), F.lit(0)))


def evidence(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """For each row its non-null facts as name=value, sorted by name, joined by semicolons."""
    pairs = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}="), F.col(n).cast("string"))) for n in sorted(names)]
    return rows.select(key, F.concat_ws(";", *pairs).alias("evidence"))
