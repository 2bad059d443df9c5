"""Tiers of tiles as bytes: what a client gets, what a quality check gets, and a search for what a client must not get.

A tier is rows of encoded tiles under one header: its level, how far its
surface may be from the samples, for whom it is, and how arrays are packed.
A tile's content is a fixed prefix, a list of its arrays, and the arrays:
positions (32-bit floats from the tile's least corner), triangles (32-bit
numbers), a bound, and for quality checks the samples that vertices are
(64-bit). Packed arrays are differences of rows (whole numbers), bytes of
equal weight together, deflated. Each tile is encoded and decoded where its
rows are; a tile has the size of a lattice window.

Positions are not kept to the bit: a reader gets the float that was stored
plus the corner.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.operators.surface import placed

MAGIC = b"SGTIER01"
CLIENT, CHECK = 0, 1
STORED, PACKED = 0, 1
LEVEL = 6
#: magic, audience, codec, level, levels, arrays; tile, vertices, triangles; bound, budget; corner.
PREFIX = struct.Struct("<8sBBBBI3q2d3d")
#: name, type, items in a row, rows, stored bytes.
ENTRY = struct.Struct("<12s4sIQQ")
TILES = "tile_id long, vertex_count long, triangle_count long, bound double, raw_bytes long, content binary"


@dataclass(frozen=True)
class Tier:
    level: int
    levels: int
    budget: float
    audience: int = CLIENT
    codec: int = PACKED

    def check(self) -> None:
        """Raises for what a tier cannot be."""
        if not 0 <= self.level < self.levels <= 255:
            raise ValueError(f"level {self.level} of {self.levels}")
        if not self.budget > 0:
            raise ValueError(f"a budget of {self.budget}")
        if self.audience not in (CLIENT, CHECK) or self.codec not in (STORED, PACKED):
            raise ValueError("no such audience or codec")


def byte_shuffle(array: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on."""
    return np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.dtype.itemsize).T.tobytes() if array.size else b""


def byte_unshuffle(data: bytes, dtype: str, shape: tuple[int, ...]) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(width, -1).T.tobytes(), dtype).reshape(shape) if data else np.zeros(shape, dtype)


def delta_rows(rows: np.ndarray) -> np.ndarray:
    """Differences to the row before, whole numbers of a fixed width that wrap."""
    out = rows.copy()
    out[1:] -= rows[:-1]
    return out


def undelta_rows(rows: np.ndarray) -> np.ndarray:
    return np.cumsum(rows, axis=0, dtype=rows.dtype)


def pack(array: np.ndarray, codec: int) -> bytes:
    if codec == STORED:
        return array.tobytes()
    return zlib.compress(byte_shuffle(delta_rows(array) if array.dtype.kind in "iu" else array), LEVEL)


def unpack(data: bytes, dtype: str, shape: tuple[int, ...], codec: int) -> np.ndarray:
    if codec == STORED:
        return np.frombuffer(data, dtype).reshape(shape)
    rows = byte_unshuffle(zlib.decompress(data), dtype, shape)
    return undelta_rows(rows) if rows.dtype.kind in "iu" else rows


def encode(tier: Tier, tile_id: int, positions: np.ndarray, triangles: np.ndarray, bound: float, samples: np.ndarray | None) -> tuple[bytes, int]:
    """The content of a tile and the bytes that its arrays have unpacked; raises for what may not be written."""
    tier.check()
    if len(triangles) and (triangles.min() < 0 or triangles.max() >= len(positions)):
        raise ValueError("a triangle names a vertex that the tile does not have")
    if not np.isfinite(positions).all() or not bound >= 0:
        raise ValueError("a place or bound that is no number")
    if tier.audience == CLIENT and samples is not None:
        raise ValueError("a client's tile must not say which samples its vertices are")
    corner = positions.min(axis=0) if len(positions) else np.zeros(3)
    arrays = {"position": (positions - corner).astype("<f4"), "triangle": triangles.astype("<u4")}
    if samples is not None:
        arrays["sample"] = samples.astype("<i8").reshape(-1, 1)
    parts = [(n, a, pack(a, tier.codec)) for n, a in arrays.items()]
    head = PREFIX.pack(MAGIC, tier.audience, tier.codec, tier.level, tier.levels, len(parts), tile_id, len(positions), len(triangles), bound, tier.budget, *map(float, corner))
    entries = b"".join(ENTRY.pack(n.encode(), a.dtype.str.encode(), a.shape[1], a.shape[0], len(data)) for n, a, data in parts)
    return head + entries + b"".join(data for _, _, data in parts), sum(a.nbytes for a in arrays.values())


def header(content: bytes) -> dict:
    """The prefix of a tile alone; ValueError for anything else."""
    if len(content) < PREFIX.size:
        raise ValueError("too short for a tile")
    magic, audience, codec, level, levels, arrays, tile, vertices, triangles, bound, budget, *corner = PREFIX.unpack_from(content)
    if magic != MAGIC or audience not in (CLIENT, CHECK) or codec not in (STORED, PACKED):
        raise ValueError("not a tile")
    return {"audience": audience, "codec": codec, "level": level, "levels": levels, "arrays": arrays, "tile_id": tile, "vertex_count": vertices, "triangle_count": triangles, "bound": bound, "budget": budget, "corner": corner}


def entries(content: bytes) -> list[dict]:
    """Which arrays a tile stores, and where."""
    count, at = header(content)["arrays"], PREFIX.size
    start, out = at + count * ENTRY.size, []
    for k in range(count):
        name, dtype, width, rows, size = ENTRY.unpack_from(content, at + k * ENTRY.size)
        out.append({"name": name.rstrip(b"\0").decode(), "dtype": dtype.rstrip(b"\0").decode(), "shape": (rows, width), "start": start, "size": size})
        start += size
    if start != len(content):
        raise ValueError("a tile that is cut short, or more than a tile")
    return out


def decode(content: bytes) -> dict[str, np.ndarray]:
    """The arrays of a tile, positions in their place."""
    own = header(content)
    out = {e["name"]: unpack(content[e["start"] : e["start"] + e["size"]], e["dtype"], e["shape"], own["codec"]) for e in entries(content)}
    out["position"] = out["position"].astype(float) + own["corner"]
    if len(out["triangle"]) and out["triangle"].max() >= len(out["position"]):
        raise ValueError("a triangle names a vertex that the tile does not have")
    return out


def tiles(triangles: DataFrame, vertices: DataFrame, tier: Tier) -> DataFrame:
    """TILES from triangles (tile_id, c0, c1, c2, bound) and vertices (cell, x, y, z, sample_id); clients get no sample_id."""
    tier.check()
    known = tier.audience == CHECK
    full = placed(triangles.select(F.col("tile_id").cast("long").alias("tile_id"), "c0", "c1", "c2", F.col("bound").cast("double").alias("bound") if "bound" in triangles.columns else F.lit(0.0).alias("bound")), vertices)
    flat = full.select("tile_id", "bound", "c0", "c1", "c2", *[F.col(f"p{k}.{a}").cast("double").alias(f"{a}{k}") for k in range(3) for a in "xyz"])
    if known:
        for k in range(3):
            flat = flat.join(vertices.select(F.col("cell").alias(f"c{k}"), F.col("sample_id").alias(f"s{k}")), f"c{k}")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["c0", "c1", "c2"], kind="stable")
        cells, first, number = np.unique(rows[["c0", "c1", "c2"]].to_numpy(np.int64).ravel(), return_index=True, return_inverse=True)
        at = rows[[f"{a}{k}" for k in range(3) for a in "xyz"]].to_numpy(float).reshape(-1, 3)[first]
        samples = rows[["s0", "s1", "s2"]].to_numpy(np.int64).ravel()[first] if known else None
        tile, bound = int(rows["tile_id"].iloc[0]), float(rows["bound"].max())
        content, raw = encode(tier, tile, at, number.reshape(-1, 3), bound, samples)
        return pd.DataFrame({"tile_id": [tile], "vertex_count": [len(cells)], "triangle_count": [len(rows)], "bound": [bound], "raw_bytes": [raw], "content": [content]})

    return flat.groupBy("tile_id").applyInPandas(work, TILES)


def summary(content: bytes) -> tuple:
    """A row of described."""
    own, parts = header(content), entries(content)
    balanced = PREFIX.size + len(parts) * ENTRY.size + sum(p["size"] for p in parts) == len(content)
    return own["tile_id"], own["audience"], own["codec"], own["level"], ",".join(sorted(p["name"] for p in parts)), len(content), balanced


def described(encoded: DataFrame) -> DataFrame:
    """Columns tile_id, audience, codec, level, arrays, bytes, balanced: what tiles' prefixes and lists of arrays say."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for content in map(bytes, frame["content"]):
                rows.append(summary(content))
            yield pd.DataFrame(rows, columns=["tile_id", "audience", "codec", "level", "arrays", "bytes", "balanced"])

    return encoded.select("content").mapInPandas(read, "tile_id long, audience int, codec int, level int, arrays string, bytes long, balanced boolean")


def unpacked(encoded: DataFrame) -> DataFrame:
    """Columns tile_id, slot, x, y, z, sample_id (null for clients): the vertices that a reader gets."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in map(bytes, frame["content"]):
                own, arrays = header(content), decode(content)
                at = arrays["position"]
                samples = pd.Series(arrays["sample"].ravel(), dtype="Int64") if "sample" in arrays else pd.Series([None] * len(at), dtype="Int64")
                yield pd.DataFrame({"tile_id": own["tile_id"], "slot": np.arange(len(at)), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "sample_id": samples})

    return encoded.select("content").mapInPandas(read, "tile_id long, slot long, x double, y double, z double, sample_id long")


def needles(samples: list[int]) -> list[bytes]:
    """The byte patterns that would give samples away: numbers next to each other, of either width and byte order, and their text."""
    out = []
    for a, b in zip(samples, samples[1:], strict=False):
        out += [struct.pack(f, a, b) for f in ("<qq", ">qq")]
        if 0 <= a < 1 << 32 and 0 <= b < 1 << 32:
            out += [struct.pack(f, a, b) for f in ("<II", ">II")]
        out.append(f"{a},{b}".encode())
    return out


def inflated(content: bytes) -> Iterator[bytes]:
    """The content and all that deflates to something in it, also undone from shuffling and differences."""
    yield content
    at = content.find(b"\x78")
    while at >= 0:
        try:
            data = zlib.decompressobj().decompress(content[at:])
        except zlib.error:
            data = b""
        if data:
            yield data
            if len(data) % 8 == 0:
                rows = byte_unshuffle(data, "<i8", (len(data) // 8,))
                yield rows.tobytes()
                yield undelta_rows(rows).tobytes()
        at = content.find(b"\x78", at + 1)


def audit(encoded: DataFrame, vertices: DataFrame) -> DataFrame:
    """Columns tile_id, found: how many of the patterns of its own vertices' samples a tile's bytes hold, packed or not.

    vertices has tile_id and sample_id; a tile's patterns are of neighbours in
    the order of sample_id, 64 at most, evenly.
    """
    own = vertices.select("tile_id", "sample_id").groupBy("tile_id").agg(F.array_sort(F.collect_set("sample_id")).alias("samples"))
    both = encoded.select("tile_id", "content").join(own, "tile_id")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for tile, content, samples in zip(frame["tile_id"], frame["content"], frame["samples"], strict=True):
                ids = [int(s) for s in samples]
                step = max(1, (len(ids) - 1) // 64)
                wanted = {n for k in range(0, len(ids) - 1, step) for n in needles(ids[k : k + 2])}
                texts = list(inflated(bytes(content)))
                rows.append((int(tile), sum(any(n in t for t in texts) for n in wanted)))
            yield pd.DataFrame(rows, columns=["tile_id", "found"])

    return both.mapInPandas(look, "tile_id long, found long")
