"""Deterministic samples, ranks over a global order, and nearest-row joins."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.session import shared_folder


def lattice_stride(scan: DataFrame, k: int) -> DataFrame:
    """Every k-th row and column of a lattice."""
    return scan.where((F.col("row") % k == 0) & (F.col("col") % k == 0))


def _offsets(rows: DataFrame, order: str, amount) -> DataFrame:
    """rows range-partitioned by order, with the amount before each row in column _before and the total in _total.

    The running sum is local to a partition; what stands before a partition is
    a sum over the partitions' totals, a table with a row for each partition.
    Both come from one dealing of the rows, which a checkpoint keeps: dealt a
    second time, ranges could have other ends.
    """
    shared_folder(rows.sparkSession)
    dealt = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).withColumn("_amount", amount).checkpoint()
    sums = dealt.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    # One row a partition: the window over all of them is bounded by their number.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    local = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(starts), "_part").withColumn("_before", F.col("_start") + F.sum("_amount").over(local) - F.col("_amount")).drop("_part", "_start")


def percentiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles of a column, interpolated between neighbours; nulls don't count, without values all are null.

    Values are ranked over ranges, so no task sees all of them; two rows for
    each percentile come to the driver.
    """
    placed = _offsets(rows.select(F.col(value).cast("double").alias("_value")).where("_value is not null"), "_value", F.lit(1).cast("long"))
    place = F.col("_before").cast("long")
    ends = [e for s in shares for at in [(F.col("_total") - 1) * F.lit(float(s))] for e in (F.floor(at), F.ceil(at))]
    rank = reduce(lambda a, b: a | b, [place == e.cast("long") for e in ends])
    found = {r["k"]: (r["_value"], r["_total"]) for r in placed.where(rank).select(place.alias("k"), "_value", "_total").collect()}
    if not found:
        return [None] * len(shares)
    total = next(iter(found.values()))[1]
    out = []
    for s in shares:
        at = (total - 1) * float(s)
        a, b = found[math.floor(at)][0], found[math.ceil(at)][0]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out


def dense_rank(rows: DataFrame, order: str, name: str) -> DataFrame:
    """The place of each row in the order of a unique column, from 0, without one task sorting all rows."""
    return _offsets(rows, order, F.lit(1).cast("long")).withColumn(name, F.col("_before").cast("long")).drop("_before", "_amount", "_total")


def every_kth(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Each k-th row in the order of a unique column, with its ordinal."""
    return dense_rank(rows, order, "ordinal").where(F.col("ordinal") % k == 0)


def systematic(rows: DataFrame, order: str, weight: str, n: int) -> DataFrame:
    """Columns target, order: for each of n even targets along the running weight the row that covers it.

    Target k is (k + 1/2) / n of the total. A row gives the targets between
    its start and its end by arithmetic, so no target is searched for. Weights
    should be decimals: sums are then the same in any order.
    """
    placed = _offsets(rows.where(F.col(weight) > 0), order, F.col(weight))
    start, end, total = F.col("_before"), F.col("_before") + F.col("_amount"), F.col("_total")
    first = (start / total * n - 0.5).cast("double")
    last = (end / total * n - 0.5).cast("double")
    guess = F.sequence(F.greatest(F.floor(first) - 1, F.lit(0)).cast("long"), F.least(F.ceil(last) + 1, F.lit(n - 1)).cast("long"))
    found = placed.select(order, start.alias("s"), end.alias("e"), total.alias("t"), F.explode(guess).alias("target"))
    middle = (2 * F.col("target") + 1) * F.col("t")
    return found.where((middle >= 2 * n * F.col("s")) & (middle < 2 * n * F.col("e"))).select("target", order)


def row_bands(scan: DataFrame, band_rows: int, halo: int) -> DataFrame:
    """Each row of samples in its band and in those whose halo holds it; core marks its own."""
    last = scan.agg(F.max(F.floor(F.col("row") / band_rows)).alias("_last"))
    lowest = F.greatest(F.floor((F.col("row") - halo) / band_rows), F.lit(0))
    highest = F.least(F.floor((F.col("row") + halo) / band_rows), F.col("_last"))
    out = scan.join(F.broadcast(last)).withColumn("band", F.explode(F.sequence(lowest, highest))).drop("_last")
    return out.withColumn("core", F.floor(F.col("row") / band_rows) == F.col("band"))


def nearest_exact(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 2000) -> DataFrame:
    """Columns query_id, rank, key, distance: the k nearest by Euclidean distance, other keys only, ties to the smaller.

    Queries come to the rows in broadcast blocks of bounded size, which hold
    the rows' distances in one matrix after the other; a task keeps the k best
    of each query over all its rows and hands on k rows a query. Vectors are
    numbers of one length; rows without a vector or key take no part.
    """
    own = rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull())
    asked = queries.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull())
    blocks = max(1, -(-asked.count() // block))
    found = [_nearest_block(own, asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect(), key, k) for b in range(blocks)]
    order = Window.partitionBy("query_id").orderBy("distance", key)
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_block(rows: DataFrame, asked: list, key: str, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r[key] for r in asked], np.int64), np.array([r["v"] for r in asked], float)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points = shared.value
        best, keys = np.full((len(names), k), np.inf), np.zeros((len(names), k), np.int64)
        for batch in batches if len(names) else ():
            if not len(batch):
                continue
            every, ids = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), batch.column(0).to_numpy()
            step = max(1, 2_000_000 // (len(names) * every.shape[1]))
            for a in range(0, len(ids), step):
                off = points[:, None, :] - every[None, a : a + step]
                d = np.sqrt((off * off).sum(axis=2))
                d[names[:, None] == ids[None, a : a + step]] = np.inf
                d, c = np.concatenate([best, d], axis=1), np.concatenate([keys, np.broadcast_to(ids[a : a + step], d.shape)], axis=1)
                take = np.lexsort((c, d), axis=1)[:, :k]
                best, keys = np.take_along_axis(d, take, 1), np.take_along_axis(c, take, 1)
        q, n = np.nonzero(best < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.int64()), pa.array(keys[q, n], pa.int64()), pa.array(best[q, n], pa.float64())], ["query_id", key, "distance"])

    return rows.mapInArrow(search, f"query_id long, {key} long, distance double")


#: Rows of a block of bands on average, and the most that a task holds.
BLOCK_ROWS = 1 << 16
MOST_IN_BLOCK = 2_000_000


def band_nearest(left: DataFrame, right: DataFrame, key: str, band: str, value: str, reach: int) -> DataFrame:
    """Columns key, nearest: the least difference in value to rows of other keys at most reach bands away, null if there is none.

    Bands are dealt in blocks of neighbours, rows of right also to the blocks
    that they reach, and a task holds a block in arrays. Within a band rows are
    put in the order of value; the nearest below is then the last one of
    another key before a row and the nearest above the first one behind it, so
    no pairs are made. Blocks of more than MOST_IN_BLOCK rows are not held by a
    task: their rows go to each band in reach and through windows there. Keys
    of right are of one row each where that happens, otherwise keys may repeat;
    rows of left without a band or value have a null.
    """
    asked = left.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"), F.col(band).cast("long").alias("_b"), F.lit(True).alias("_asks"))
    there = right.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"), F.col(band).cast("long").alias("_b"), F.lit(False).alias("_asks")).where("_k is not null and _v is not null and _b is not null")
    part = F.col("_k").isNotNull() & F.col("_v").isNotNull() & F.col("_b").isNotNull()
    without = asked.where(~part).select("_k", F.lit(None).cast("double").alias("_gap"))
    asked = asked.where(part)
    size = there.agg(F.count("*").alias("n"), F.min("_b").alias("a"), F.max("_b").alias("b")).first()
    width = max(2 * reach + 1, -(-(size["b"] - size["a"] + 1) * BLOCK_ROWS // size["n"]) if size["n"] else 1)
    block = lambda b: F.floor(b / F.lit(width)).cast("long")
    around = F.array_distinct(F.array(block(F.col("_b") - reach), block(F.col("_b") + reach)))
    rows = asked.withColumn("_block", block(F.col("_b"))).unionByName(there.withColumn("_block", F.explode(around)))
    crowded = [r["_block"] for r in rows.groupBy("_block").count().where(F.col("count") > MOST_IN_BLOCK).collect()]
    slow = asked.where(block(F.col("_b")).isin(crowded)) if crowded else None
    rows = rows.where(~F.col("_block").isin(crowded)) if crowded else rows
    kind = asked.schema["_k"].dataType.simpleString()

    def work(table: pa.Table) -> pa.Table:
        asks = table.column("_asks").to_numpy()
        names = table.column("_k").combine_chunks().dictionary_encode().indices.to_numpy()
        gaps = band_gaps(table.column("_b").to_numpy(), table.column("_v").to_numpy(), names, asks, reach)
        none = np.isneginf(gaps)
        return pa.table([table.column("_k").filter(pa.array(asks)).combine_chunks(), pa.array(gaps, mask=none)], ["_k", "_gap"])

    out = rows.groupBy("_block").applyInArrow(work, f"_k {kind}, _gap double").unionByName(without)
    if slow is not None:
        out = out.unionByName(_window_gaps(slow, there, reach))
    return out.groupBy(F.col("_k").alias(key)).agg(F.min("_gap").alias("nearest"))


def band_gaps(bands: np.ndarray, values: np.ndarray, names: np.ndarray, asks: np.ndarray, reach: int) -> np.ndarray:
    """For each row that asks the least difference to the other rows of other names at most reach bands away, -inf without any; NaN counts as largest."""
    b, v, k = bands[~asks], values[~asks], names[~asks]
    ours, mine, own = bands[asks], values[asks], names[asks]
    best = np.full(len(ours), -np.inf)
    if not len(b) or not len(ours):
        return best
    # Ranks of values, so that a band and a value are one number.
    known = np.unique(np.r_[v, mine])
    rank = np.searchsorted(known, v)
    low = min(b.min(), ours.min() - reach)
    step = len(known) + 1
    order = np.lexsort((k, rank, b))
    code, b, v, k = ((b - low) * step + rank)[order], b[order], v[order], k[order]
    change = np.r_[True, k[1:] != k[:-1]]
    place = np.arange(len(k))
    # The last entry of another name before each, and the first behind.
    prior = np.maximum.accumulate(np.where(change, place, 0)) - 1
    after = np.minimum.accumulate(np.where(np.r_[change[1:], True], place, len(k))[::-1])[::-1] + 1
    wanted = np.searchsorted(known, mine)
    turn = np.lexsort((wanted, ours))
    ours, mine, own, wanted = ours[turn], mine[turn], own[turn], wanted[turn]
    found = np.full(len(ours), -np.inf)

    def meet(at: np.ndarray, beyond: np.ndarray, band: np.ndarray) -> None:
        there = (at >= 0) & (at < len(k))
        at = np.where(there, at, 0)
        at = np.where(there & (k[at] == own), beyond[at], np.where(there, at, -1))
        ok = (at >= 0) & (at < len(k))
        at = np.where(ok, at, 0)
        ok &= b[at] == band
        with np.errstate(invalid="ignore"):
            gap = np.abs(v[at] - mine)
        found[ok] = np.where(found[ok] == -np.inf, gap[ok], np.fmin(found[ok], gap[ok]))

    infinite = np.isinf(mine).any()
    for off in range(-reach, reach + 1):
        band = ours + off
        ask = (band - low) * step + wanted
        end = np.searchsorted(code, ask, "right")
        meet(end - 1, prior, band)
        meet(end, after, band)
        if infinite:
            # Equal infinities have no difference, others do.
            meet(np.searchsorted(code, ask) - 1, prior, band)
    best[turn] = found
    return best


def _window_gaps(asked: DataFrame, there: DataFrame, reach: int) -> DataFrame:
    """Columns _k, _gap: band_gaps through windows over each band."""
    asked = asked.withColumn("_b", F.explode(F.sequence(F.col("_b") - reach, F.col("_b") + reach)))
    before, behind = Window.partitionBy("_b").orderBy("_v", "_asks", "_k"), Window.partitionBy("_b").orderBy(F.desc("_v"), "_asks", "_k")
    mine = F.when(~F.col("_asks"), F.struct("_k", "_v"))
    out = there.unionByName(asked)
    for name, order in (("below", before), ("above", behind)):
        # A row's own row may be the last one, so that one knows the one before it.
        chain = F.last(mine, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(f"{name}_1", chain)
        out = out.withColumn(f"{name}_2", F.last(F.when(~F.col("_asks"), F.struct(F.col("_k"), F.col(f"{name}_1").alias("prior"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    gaps = []
    for name in ("below", "above"):
        first, second = F.col(f"{name}_1"), F.col(f"{name}_2")["prior"]
        gaps.append(F.when(first["_k"] != F.col("_k"), F.abs(first["_v"] - F.col("_v"))).otherwise(F.abs(second["_v"] - F.col("_v"))))
    return out.where("_asks").select("_k", F.least(*gaps).alias("_gap"))
