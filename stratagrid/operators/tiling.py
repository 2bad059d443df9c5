"""Tiles of a lattice: windows of cells, who owns what, and counts of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_of(row: Column, col: Column, cols: int, tile_rows: int, tile_cols: int) -> Column:
    """The window of a cell, numbered row by row."""
    across = -(-cols // tile_cols)
    return (F.floor(row / tile_rows) * across + F.floor(col / tile_cols)).cast("long")


def with_tile(cells: DataFrame, cols: int, tile_rows: int, tile_cols: int) -> DataFrame:
    return cells.withColumn("tile_id", tile_of(F.col("row"), F.col("col"), cols, tile_rows, tile_cols))


def placed_triangles(triangles: DataFrame, cols: int, tile_rows: int, tile_cols: int) -> DataFrame:
    """Each triangle in every tile that holds a corner; the least of them is its owner."""
    corners = F.array_distinct(F.array(*[tile_of(F.floor(F.col(c) / cols), F.col(c) % cols, cols, tile_rows, tile_cols) for c in ("c0", "c1", "c2")]))
    return triangles.withColumn("owner", F.array_min(corners)).withColumn("tile_id", F.explode(corners))


def halo(placed: DataFrame, cols: int, tile_rows: int, tile_cols: int) -> DataFrame:
    """Columns tile_id, cell: corners of a tile's triangles (tile_id, c0, c1, c2) that lie in another tile."""
    corners = placed.select("tile_id", F.explode(F.array("c0", "c1", "c2")).alias("cell"))
    home = tile_of(F.floor(F.col("cell") / cols), F.col("cell") % cols, cols, tile_rows, tile_cols)
    return corners.where(home != F.col("tile_id")).distinct()


def manifest(triangles: DataFrame, cols: int, tile_rows: int, tile_cols: int) -> DataFrame:
    """For each tile the triangles that touch it and those that it owns."""
    placed = placed_triangles(triangles, cols, tile_rows, tile_cols)
    return placed.groupBy("tile_id").agg(F.count("*").alias("triangle_count"), F.count_if(F.col("owner") == F.col("tile_id")).alias("owned_count"))
