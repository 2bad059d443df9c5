"""Accuracy reports and rule checks: single aggregations over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.operators.sampling import percentiles
from stratagrid.session import shared_folder


def deviation(rows: DataFrame, value: str, near: float, far: float) -> DataFrame:
    """One row: count, RMS, mean, exact percentiles, maximum, shares within two bounds, and the signed mean.

    Nothing is rounded. Without rows all figures are 0, as a count of 0 says.
    Percentiles come from ranks over ranges, see sampling.percentiles.
    """
    size = F.abs(F.col(value))
    # Values are computed once; ranks and figures read the same ones.
    shared_folder(rows.sparkSession)
    kept = rows.select(F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()).checkpoint()
    p95, p99_9 = percentiles(kept.select(size.alias("size")), "size", [0.95, 0.999])
    figures = {
        "rms": F.sqrt(F.avg(F.col(value) * F.col(value))), "mean": F.avg(size), "p95": F.lit(p95).cast("double"), "p99_9": F.lit(p99_9).cast("double"),
        "maximum": F.max(size), "within_near": F.avg((size <= near).cast("int")), "within_far": F.avg((size <= far).cast("int")), "mean_signed": F.avg(value),
    }
    return kept.agg(F.count("*").alias("n"), *[F.coalesce(x, F.lit(0.0)).alias(n) for n, x in figures.items()])


def signed_deviation(rows: DataFrame, value: str, key: str, bound: float = 0.001, wide: float = 0.0032, certain: str | None = None) -> DataFrame:
    """One row: like deviation, with the bias (signed mean), shares ahead, behind and of zeros, and of certified rows.

    certain names a boolean column that says whether a row's distance is proven
    to be the least; without one all are. key only names what rows are of.
    """
    size = F.abs(F.col(value))
    proven = F.col(certain) if certain else F.lit(True)
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    return rows.where(F.col(value).isNotNull()).agg(
        F.count("*").alias("n"),
        F.countDistinct(key).alias("keys"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_signed"),
        F.coalesce(F.sqrt(F.avg(F.col(value) * F.col(value))), F.lit(0.0)).alias("rms"),
        F.count_if(F.col(value) < 0).alias("behind"),
        F.count_if(F.col(value) > 0).alias("ahead"),
        share(size == 0).alias("zero_share"),
        share(size <= bound).alias("within_bound"),
        share(size <= wide).alias("within_wide"),
        share(proven).alias("certified"),
    )


def mover_score(judged: DataFrame) -> DataFrame:
    """One row from columns mover (truth) and keep (verdict)."""
    counts = judged.agg(
        F.count_if("mover").alias("movers"),
        F.count_if(F.col("mover") & ~F.col("keep")).alias("caught"),
        F.count_if(~F.col("mover") & ~F.col("keep")).alias("false_alarms"),
        F.count_if(F.col("mover") & F.col("keep")).alias("kept_movers"),
        F.count("*").alias("samples"),
    )
    return counts.withColumn("recall", F.try_divide("caught", "movers")).withColumn("false_positive", F.try_divide("false_alarms", F.col("samples") - F.col("movers"))).drop("samples")


def circular_variance(rows: DataFrame, key: str, angle: str) -> DataFrame:
    """One minus the length of the mean direction, for each key."""
    mean = rows.groupBy(key).agg(F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"))
    return mean.select(key, F.round(1 - F.sqrt(F.col("c") ** 2 + F.col("s") ** 2), 6).alias("variance"))


def quantisation_findings(axes: DataFrame, key: str, most_scale: float = 0.001, most_raw: float = 2147483647) -> DataFrame:
    """Columns key, finding for axes (scale, bound) that break a rule, the first rule that they break."""
    finding = F.when(F.col("scale") <= 0, "invalid scale").when(F.col("scale") > most_scale, "coarse scale").when(F.col("bound") / F.col("scale") > most_raw, "overflow")
    return axes.select(key, finding.alias("finding")).where("finding is not null")
