import random

from pyspark.sql import functions as F

from stratagrid.operators import stencil
from stratagrid.streaming import bands


def _rows(count: int = 400) -> list:
    rng = random.Random(8)
    rows = [("s" if k % 3 else "t", rng.randrange(24), rng.randrange(10), rng.choice([4.0, 4.01, 7.0]), k) for k in range(count)]
    return rows + [("s", None, 2, 1.0, 9000), ("s", 3, None, 1.0, 9001)]


def test_stream_equals_batch(spark, tmp_path):
    rows = _rows()
    random.Random(1).shuffle(rows)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(0, len(rows), 80):
        spark.createDataFrame(rows[k : k + 80], bands.SCAN).coalesce(1).write.mode("append").parquet(source)
        if k == 160:
            bands.clean_stream(bands.read_scan_stream(spark, source, 1), folder, 10, True, 4)
    # The second call goes on from the checkpoint of the first.
    bands.clean_stream(bands.read_scan_stream(spark, source, 2), folder, 10, True, 4)
    whole = spark.createDataFrame(rows, bands.SCAN).where("row is not null and col is not null")
    want = stencil.despeckle(stencil.dedupe_last(whole, ["station_id", "row", "col"], ["sample_id", "rng"]), 10, True)
    columns = ["station_id", "row", "col", "rng", "keep", "support", "available"]
    got = spark.read.parquet(f"{folder}/clean").select(columns).collect()
    assert sorted(got) == sorted(want.select(columns).collect())


def test_range_grid_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(_rows(), bands.SCAN).repartition(3).write.parquet(source)
    grid = bands.range_grid_stream(bands.read_scan_stream(spark, source, 1), ["row", "col"])
    query = grid.writeStream.format("memory").queryName("grid_so_far").outputMode("complete").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = spark.createDataFrame(_rows(), bands.SCAN).groupBy("row", "col").agg(F.min("rng").alias("r"))
    assert set(spark.table("grid_so_far").collect()) == set(want.collect())
