"""Scans that arrive as streams.

mesh_stream takes stations all the way: to verdicts, triangles and pieces, band
by band as samples arrive. range_grid_stream keeps the nearest return of each direction as Spark's own
streaming aggregate. clean_stream despeckles a scan while it arrives: samples
go to a table partitioned by station and row band, and each micro-batch judges
again just the bands of its stations that its samples can change, with the
batch operator on the band's rows and the rows around. Its result after the last batch is the batch
operator's on all samples, in whatever order they came.

A micro-batch may be run twice (after a failure): its samples are written to a
folder of the batch's own number, and bands are overwritten, so nothing counts
twice. Repeated cells are the batch operator's to resolve, the last sample_id
wins. Rows with a null row or col are left out, as they are no cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratagrid.operators import station, stencil

SCAN = "station_id string, row int, col int, rng double, sample_id long"
#: How many rows away a sample changes what is judged.
REACH = 1


def read_scan_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Samples from Parquet files as they come into a folder."""
    return spark.readStream.schema(SCAN).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def range_grid_stream(samples: DataFrame, keys: list[str], rng: str = "rng", least: float = 1e-6) -> DataFrame:
    """The nearest return of each direction so far; write it in update or complete mode."""
    return samples.where(F.col(rng) > least).groupBy(*keys).agg(F.min(rng).alias("r"))


def _band(row, band_rows: int):
    return F.floor(row / band_rows).cast("int")


def clean_stream(samples: DataFrame, folder: str, cols: int, wrap: bool, band_rows: int = 256, tol_abs: float = 0.02, tol_rel: float = 0.006) -> StreamingQuery:
    """Despeckles a stream of samples into folder/clean; ends when what is there has been read.

    folder is one that all executors reach; its checkpoint is there as well, so
    a later call goes on where this one ended.
    """
    raw, clean = f"{folder}/raw", f"{folder}/clean"

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.where("row is not null and col is not null").withColumn("band", _band(F.col("row"), band_rows))
        own.write.mode("overwrite").partitionBy("station_id", "band").parquet(f"{raw}/batch={number}")
        fields = SCAN + ", band int"
        fresh = spark.read.schema(fields).parquet(f"{raw}/batch={number}")
        # One row for each station and band that is new or beside a new row.
        bands = F.explode(F.array_distinct(F.array(*[_band(F.col("row") + d, band_rows) for d in (-REACH, 0, REACH)]))).alias("band")
        changed = fresh.select("station_id", bands).distinct()
        if changed.isEmpty():
            return
        around = changed.select("station_id", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band")).distinct()
        rows = spark.read.schema(fields + ", batch int").parquet(raw).drop("batch").join(F.broadcast(around), ["station_id", "band"])
        latest = stencil.dedupe_last(rows.drop("band"), ["station_id", "row", "col"], ["sample_id", "rng"])
        judged = stencil.despeckle(latest, cols, wrap, tol_abs, tol_rel).withColumn("band", _band(F.col("row"), band_rows))
        kept = judged.join(F.broadcast(changed), ["station_id", "band"], "left_semi")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("station_id", "band").parquet(clean)

    writer = samples.writeStream.foreachBatch(judge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    return query


def mesh_stream(samples: DataFrame, folder: str, lattice: station.Lattice, rules: station.Rules | None = None, need: int = 0) -> StreamingQuery:
    """Meshes stations while their samples (as station.VOTED has them) arrive; ends when what is there has been read.

    A micro-batch writes its samples once for each band that they change, so
    what a band needs lies under that band; it then works again just the bands
    of just the stations that got samples, and overwrites what they had given.
    mesh_of gives the whole mesh at any time. Samples may come in any order and
    batches may run twice.
    """
    own = rules or station.Rules()
    raw, done = f"{folder}/samples", f"{folder}/bands"
    keys = ["station_id", "band"]

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = station.on_lattice(batch, lattice).select(*station.VOTED).withColumn("band", F.explode(station.bands_of(F.col("row"), lattice.rows, own.band_rows)))
        dealt.write.mode("overwrite").partitionBy(*keys).parquet(f"{raw}/batch={number}")
        schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
        # Partition folders are what is joined: bands that did not change are not read.
        changed = spark.read.schema(schema).parquet(f"{raw}/batch={number}").select(*keys).distinct()
        if changed.isEmpty():
            return
        rows = spark.read.schema(schema + ", batch int").parquet(raw).drop("batch").join(F.broadcast(changed), keys)
        given = station.worked(rows, lattice, own, need, dealt=True)
        given.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "kind").parquet(done)

    query = samples.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def mesh_of(spark: SparkSession, folder: str, rules: station.Rules | None = None, source_sample_count: int | None = None) -> station.Meshed:
    """The mesh of all that mesh_stream has worked so far."""
    return station.finished(spark.read.schema(station.OUTPUT).parquet(f"{folder}/bands"), rules or station.Rules(), source_sample_count)


def ledger_stream(samples: DataFrame, disposition: str = "disposition") -> DataFrame:
    """How many samples of each station met each disposition so far; update or complete mode."""
    return samples.groupBy("station_id", disposition).agg(F.count("*").alias("samples"))
