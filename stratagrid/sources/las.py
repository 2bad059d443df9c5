"""LAS point files by Spark's binary reader: container kind, headers, raw points.

Files are found and read by Spark (any file system that it knows); a task
holds one file, which that reader limits to 2 GB. Layouts are those of the
public LAS 1.2 to 1.4 specification.

Defined results: a file that isn't LAS, is cut off, or has an unknown version
gives a row with the reason in error and null fields. A 64-bit point count
counts if it isn't zero, the older 32-bit one otherwise. A damaged chain of
variable-length records ends there. las_points raises for such files and for
compressed ones, which it can't read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic bytes of the containers. Fixed values.
MAGIC = {"LASF": "las", "ASTM-E57": "e57"}
#: Records that carry a coordinate system, and the one of compression. Fixed values.
GEOREFERENCE = {34735: "geo_keys", 34736: "geo_doubles", 34737: "geo_ascii", 2112: "wkt"}
COMPRESSION_RECORD = (b"laszip encoded", 22204)
SMALLEST_HEADER = {2: 227, 3: 235, 4: 375}
POINTS_AT_ONCE = 100_000

HEADER = "path string, version string, point_format int, record_length int, point_count long, data_offset long, compressed boolean, scales array<double>, offsets array<double>, minima array<double>, maxima array<double>, crs array<string>, error string"
POINTS = "path string, sample_id long, raw_x int, raw_y int, raw_z int, x double, y double, z double"


def records(blob: bytes, start: int, count: int) -> Iterator[tuple[bytes, int, bytes]]:
    """User id, record id and body of each variable-length record that lies whole in blob."""
    at = start
    for _ in range(count):
        if at + 54 > len(blob):
            return
        user, number, size = struct.unpack_from("<16sHH", blob, at + 2)
        if at + 54 + size > len(blob):
            return
        yield user.split(b"\0")[0], number, blob[at + 54 : at + 54 + size]
        at += 54 + size


def header_of(blob: bytes) -> dict:
    """The header's fields; ValueError names what is wrong."""
    if blob[:4] != b"LASF":
        raise ValueError("no LAS signature")
    if len(blob) < 227:
        raise ValueError("header cut off")
    major, minor = blob[24], blob[25]
    if major != 1 or minor not in SMALLEST_HEADER:
        raise ValueError(f"version {major}.{minor} not supported")
    size, data_offset, n_records, kind, length, count = struct.unpack_from("<HIIBHI", blob, 94)
    if size < SMALLEST_HEADER[minor] or len(blob) < size:
        raise ValueError("header cut off")
    if data_offset < size:
        raise ValueError("points begin inside the header")
    if minor == 4:
        count = struct.unpack_from("<Q", blob, 247)[0] or count
    numbers = struct.unpack_from("<12d", blob, 131)
    found = list(records(blob[:data_offset], size, n_records))
    return {
        "version": f"{major}.{minor}",
        "point_format": kind & 0x3F,
        "record_length": length,
        "point_count": count,
        "data_offset": data_offset,
        "compressed": bool(kind & 0x80) or any((user, number) == COMPRESSION_RECORD for user, number, _ in found),
        "scales": list(numbers[0:3]),
        "offsets": list(numbers[3:6]),
        "minima": list(numbers[7::2]),
        "maxima": list(numbers[6::2]),
        "crs": sorted({GEOREFERENCE[number] for _, number, _ in found if number in GEOREFERENCE}),
    }


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def containers(spark: SparkSession, path: str) -> DataFrame:
    """Columns path, kind (las, laz, e57 or unknown), sha256: kinds by content, never by name."""
    head = F.substring("content", 1, 8)
    kind = F.when(head == F.lit(b"ASTM-E57"), "e57").when(F.substring("content", 1, 4) == F.lit(b"LASF"), "las").otherwise("unknown")
    own = _files(spark, path).select("path", kind.alias("kind"), F.sha2("content", 256).alias("sha256"))
    packed = las_headers(spark, path).select("path", F.coalesce("compressed", F.lit(False)).alias("packed"))
    return own.join(packed, "path").select("path", F.when(F.col("packed"), "laz").otherwise(F.col("kind")).alias("kind"), "sha256")


def las_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file with its header's fields, or the reason why it has none."""
    names = [x.split()[0] for x in HEADER.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows.append({"path": name, **header_of(blob.as_py())})
                except ValueError as wrong:
                    rows.append({"path": name, "error": str(wrong)})
            columns = [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, _HEADER_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return _files(spark, path).select("path", "content").mapInArrow(read, HEADER)


_NUMBERS = pa.list_(pa.float64())
_HEADER_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), _NUMBERS, _NUMBERS, _NUMBERS, _NUMBERS, pa.list_(pa.string()), pa.string()]


def raw_points(blob: bytes, own: dict) -> np.ndarray:
    """An array of 32-bit x, y, z of all points."""
    need = own["data_offset"] + own["point_count"] * own["record_length"]
    if own["record_length"] < 12 or len(blob) < need:
        raise ValueError("points cut off")
    body = np.frombuffer(blob, np.uint8, own["point_count"] * own["record_length"], own["data_offset"])
    return np.ascontiguousarray(body.reshape(-1, own["record_length"])[:, :12]).view("<i4")


def las_points(spark: SparkSession, path: str) -> DataFrame:
    """Every point with its place in its file (sample_id), raw and scaled."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = blob.as_py()
                own = header_of(blob)
                if own["compressed"]:
                    raise ValueError(f"{name}: compressed points can't be read")
                raw = raw_points(blob, own)
                for at in range(0, len(raw), POINTS_AT_ONCE):
                    part = raw[at : at + POINTS_AT_ONCE]
                    scaled = part * np.array(own["scales"]) + np.array(own["offsets"])
                    ids = pa.array(np.arange(at, at + len(part)), pa.int64())
                    columns = [pa.array([name] * len(part)), ids, *[pa.array(part[:, k], pa.int32()) for k in range(3)], *[pa.array(scaled[:, k]) for k in range(3)]]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in POINTS.split(", ")])

    return _files(spark, path).select("path", "content").mapInArrow(read, POINTS)


def las_findings(headers: DataFrame) -> DataFrame:
    """Columns path, axis, finding: axes whose scale or bounds break a rule."""
    from stratagrid.operators.reports import quantisation_findings

    axes = F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in "xyz"]).alias("axis"), "scales", "offsets", "minima", "maxima"))
    rows = headers.where("error is null").select("path", axes.alias("a"))
    bound = F.greatest(F.abs(F.col("a.minima") - F.col("a.offsets")), F.abs(F.col("a.maxima") - F.col("a.offsets")))
    keyed = rows.select(F.struct("path", F.col("a.axis").alias("axis")).alias("k"), F.col("a.scales").alias("scale"), bound.alias("bound"))
    return quantisation_findings(keyed, "k").select("k.path", "k.axis", "finding")
