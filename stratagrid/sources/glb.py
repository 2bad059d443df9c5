"""Binary glTF 2.0 tiles: one self-contained file's bytes for each tile, as rows.

A tile's rows meet in one task; tiles are lattice windows, so their size has a
bound. Positions are 32-bit floats relative to the tile's least corner, which
is the node's translation; indices are unsigned 32-bit. Cell numbers are not
stored, so a client cannot tell which sample a vertex was.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.operators.surface import placed

# Fixed values of the binary glTF 2.0 format.
MAGIC, VERSION = b"glTF", 2
JSON_CHUNK, BIN_CHUNK = b"JSON", b"BIN\0"
FLOAT, UNSIGNED_INT = 5126, 5125
ARRAY_BUFFER, ELEMENT_ARRAY_BUFFER = 34962, 34963

ENCODED = "tile_id long, vertex_count long, triangle_count long, content binary"
AUDIT = "tile_id long, vertex_count long, triangle_count long, header_bytes long, json_bytes long, position_bytes long, index_bytes long, padding_bytes long, total_bytes long, balanced boolean"


def encode(positions: np.ndarray, indices: np.ndarray) -> bytes:
    """The bytes of a tile; refuses indices beyond its vertices and coordinates that aren't finite."""
    if len(indices) and (indices.min() < 0 or indices.max() >= len(positions)):
        raise ValueError("a triangle names a vertex that the tile does not have")
    if not np.isfinite(positions).all():
        raise ValueError("a vertex is not finite")
    origin = positions.min(axis=0)
    local = (positions - origin).astype("<f4")
    points, corners = local.tobytes(), indices.astype("<u4").tobytes()
    views = [{"buffer": 0, "byteOffset": 0, "byteLength": len(points), "target": ARRAY_BUFFER}, {"buffer": 0, "byteOffset": len(points), "byteLength": len(corners), "target": ELEMENT_ARRAY_BUFFER}]
    accessors = [
        {"bufferView": 0, "componentType": FLOAT, "count": len(local), "type": "VEC3", "min": local.min(axis=0).tolist(), "max": local.max(axis=0).tolist()},
        {"bufferView": 1, "componentType": UNSIGNED_INT, "count": indices.size, "type": "SCALAR"},
    ]
    scene = {
        "asset": {"version": "2.0"},
        "scene": 0,
        "scenes": [{"nodes": [0]}],
        "nodes": [{"mesh": 0, "translation": origin.tolist()}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "buffers": [{"byteLength": len(points) + len(corners)}],
        "bufferViews": views,
        "accessors": accessors,
    }
    text = json.dumps(scene, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    body = points + corners
    parts = struct.pack("<I4s", len(text), JSON_CHUNK) + text + struct.pack("<I4s", len(body), BIN_CHUNK) + body
    return struct.pack("<4sII", MAGIC, VERSION, 12 + len(parts)) + parts


def decode(content: bytes) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Positions, triangles and how many bytes each part takes; ValueError for anything else than encode writes."""
    if len(content) < 28:
        raise ValueError("too short for binary glTF")
    magic, version, total = struct.unpack_from("<4sII", content)
    if magic != MAGIC or version != VERSION or total != len(content):
        raise ValueError("not binary glTF 2.0, or cut short")
    size, kind = struct.unpack_from("<I4s", content, 12)
    if kind != JSON_CHUNK or 28 + size > total:
        raise ValueError("the first chunk is not the scene")
    text = content[20 : 20 + size]
    body_size, kind = struct.unpack_from("<I4s", content, 20 + size)
    body = content[28 + size : 28 + size + body_size]
    if kind != BIN_CHUNK or len(body) != body_size:
        raise ValueError("the second chunk is not the buffer")
    scene = json.loads(text)
    points, corners = scene["accessors"]
    views = scene["bufferViews"]
    local = np.frombuffer(body, "<f4", points["count"] * 3, views[0]["byteOffset"]).reshape(-1, 3)
    indices = np.frombuffer(body, "<u4", corners["count"], views[1]["byteOffset"]).reshape(-1, 3)
    if len(indices) and indices.max() >= len(local):
        raise ValueError("a triangle names a vertex that the tile does not have")
    plain = len(text.rstrip(b" "))
    ledger = {"header": 28, "json": plain, "position": views[0]["byteLength"], "index": views[1]["byteLength"], "padding": len(text) - plain, "total": total}
    return local.astype(float) + np.array(scene["nodes"][0]["translation"]), indices.astype(np.int64), ledger


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    cells = rows[["c0", "c1", "c2"]].to_numpy(np.int64).ravel()
    points = np.stack([rows[[f"{n}{k}" for n in "abc"]].to_numpy(float).ravel() for k in "xyz"], axis=1)
    own, first, indices = np.unique(cells, return_index=True, return_inverse=True)
    # Triangles in a fixed order, so that equal tiles have equal bytes.
    faces = indices.reshape(-1, 3)
    faces = faces[np.lexsort(faces.T[::-1])]
    return pd.DataFrame({"tile_id": [rows["tile_id"].iloc[0]], "vertex_count": [len(own)], "triangle_count": [len(faces)], "content": [encode(points[first], faces)]})


def glb_tiles(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Columns tile_id, vertex_count, triangle_count, content from triangles (tile_id, c0, c1, c2) and vertices (cell, x, y, z).

    A triangle with a vertex that is not there raises.
    """
    placed_ = placed(triangles.select(F.col("tile_id").cast("long").alias("tile_id"), "c0", "c1", "c2"), vertices)
    faces = placed_.select("tile_id", "c0", "c1", "c2", *[F.col(f"p{i}.{k}").cast("double").alias(f"{'abc'[i]}{k}") for i in range(3) for k in "xyz"])
    return faces.groupBy("tile_id").applyInPandas(_tile, ENCODED)


def audit(tiles: DataFrame) -> DataFrame:
    """What decoding each tile's content (tile_id, content) finds, and whether its bytes add up."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tile, content in zip(frame["tile_id"], frame["content"], strict=True):
                points, faces, ledger = decode(bytes(content))
                parts = [ledger[k] for k in ("header", "json", "position", "index", "padding")]
                out.append((tile, len(points), len(faces), *parts, ledger["total"], sum(parts) == ledger["total"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")])

    return tiles.select("tile_id", "content").mapInPandas(check, AUDIT)
