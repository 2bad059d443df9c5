"""Approximate nearest neighbours (operator 3): anisotropic four-bit quantisation.

Vectors are brought to unit length and cut into parts of two dimensions; each
part is one of sixteen centres, so a vector is four bits a part. Centres and
codes minimise a score-aware loss: a residual along the vector costs ETA times
what a residual across it costs, as that is what disturbs large inner products.
The centres are fitted on a bounded sample (SAMPLE_ROWS vectors in
expectation, by a hash of vec_id); every vector is coded and stands in the
index. For a query the inner products of its parts with the centres are a
table; tables are rounded to eight bits and two parts share one look-up, a
scan adds them up for a block of vectors, and the RERANK best of the block are
ranked exactly with their original vectors in double precision. So is every
other vector of the block whose sum could still hide one of the k best: its
quantised score, with the rounding of the table and the length of its residual
as bounds, isn't below the k-th best exact score. What is returned is exact.

Queries come in blocks of at most QUERY_BLOCK, which bounds what is broadcast;
each block is compared with all vectors. A task keeps the k best so far of
each query over all its blocks of vectors and hands on k rows a query, so what
is shuffled does not grow with the blocks; the k-th score so far also prunes
the blocks that follow. The last ranking is a window that Spark cuts before
the shuffle.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part. Vectors of different lengths have no cosine, so each
length is searched apart. Components may be of any finite size: a vector is
scaled by a power of two first, which is exact. A candidate with the
query's own id is never returned. If several rows are one query's id, the
query is the first of them in the order of the scaled components. Rows that repeat
another id are candidates of their own. Ties go to the smaller id. With fewer
than k candidates all are returned. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CENTRES = 16
PART = 2
SAMPLE_ROWS = 8_000
ROUNDS = 8
#: Weight of the residual along a vector; (d - 1) t**2 / (1 - t**2) for a threshold t of 0.2 and 64 dimensions.
ETA = 2.6
RERANK = 128
#: What scores may be off by rounding.
SLACK = 1e-9
BLOCK = 8192
QUERY_BLOCK = 8192
QUERIES_AT_ONCE = 128


def _padded(unit: np.ndarray) -> np.ndarray:
    """Parts of each vector, with zeros to whole parts and pairs of parts."""
    rest = -unit.shape[1] % (2 * PART)
    return np.pad(unit, ((0, 0), (0, rest))).reshape(len(unit), -1, PART)


def _choose(parts: np.ndarray, centres: np.ndarray, codes: np.ndarray, eta: float) -> np.ndarray:
    """One round of coordinate descent over the parts' codes."""
    rows = np.arange(len(parts))
    across = np.einsum("nmd,nmd->nm", parts - centres[np.arange(parts.shape[1]), codes], parts)
    total = across.sum(axis=1)
    for m in range(parts.shape[1]):
        x = parts[:, m]
        others = total - across[:, m]
        plain = ((x[:, None] - centres[m][None]) ** 2).sum(axis=2)
        along = (x**2).sum(axis=1)[:, None] - x @ centres[m].T
        loss = plain + (eta - 1) * (others[:, None] + along) ** 2
        codes[:, m] = loss.argmin(axis=1)
        across[:, m] = along[rows, codes[:, m]]
        total = others + across[:, m]
    return codes


def _nearest(parts: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((parts[:, m, None] - centres[m][None]) ** 2).sum(axis=2).argmin(axis=1) for m in range(parts.shape[1])], axis=1)


def codes_of(unit: np.ndarray, centres: np.ndarray, eta: float = ETA, rounds: int = 2) -> np.ndarray:
    """The parts' codes of unit vectors."""
    parts = _padded(unit)
    codes = _nearest(parts, centres)
    for _ in range(rounds):
        codes = _choose(parts, centres, codes, eta)
    return codes


def fit_centres(unit: np.ndarray, eta: float = ETA, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centres of each part, by turns of choosing codes and solving for centres."""
    parts = _padded(unit)
    n, m, d = parts.shape
    rng = np.random.default_rng(seed)
    centres = np.stack([parts[rng.integers(0, n, CENTRES), k] + rng.normal(0, 1e-3, (CENTRES, d)) for k in range(m)])
    codes = _nearest(parts, centres)
    for turn in range(rounds):
        strength = 1.0 if turn < 2 else eta
        codes = _choose(parts, centres, codes, strength)
        across = np.einsum("nmd,nmd->nm", parts - centres[np.arange(m), codes], parts)
        for k in range(m):
            others = across.sum(axis=1) - across[:, k]
            x = parts[:, k]
            for c in range(CENTRES):
                own = x[codes[:, k] == c]
                if len(own):
                    pull = others[codes[:, k] == c] + (own**2).sum(axis=1)
                    left = len(own) * np.eye(d) + (strength - 1) * own.T @ own
                    centres[k, c] = np.linalg.solve(left, own.sum(axis=0) + (strength - 1) * (pull[:, None] * own).sum(axis=0))
            across[:, k] = ((x - centres[k][codes[:, k]]) * x).sum(axis=1)
    return centres


def _pack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)


def tables_of(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each pair of parts, query and byte the sum of two rounded products."""
    products = np.einsum("qmd,mcd->mqc", _padded(queries), centres)
    low, high = products.min(axis=(0, 2)), products.max(axis=(0, 2))
    scale = 255 / np.maximum(high - low, 1e-12)
    rounded = np.rint((products - low[None, :, None]) * scale[None, :, None]).astype(np.int32)
    pairs = rounded[1::2, :, :, None] + rounded[0::2, :, None, :]
    return pairs.reshape(pairs.shape[0], pairs.shape[1], CENTRES * CENTRES)


class Scanner:
    """The tables of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centres: np.ndarray, k: int, rerank: int):
        self.ids, self.vectors, self.k, self.rerank = ids, vectors, k, rerank
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.centres, unit = centres, vectors / self.norms[:, None]
        self.tables = tables_of(unit, centres).astype(np.int16)
        products = np.einsum("qmd,mcd->mqc", _padded(unit), centres)
        low, high = products.min(axis=(0, 2)), products.max(axis=(0, 2))
        # A quantised score lies below low + step * sum, rounding included.
        self.step = np.maximum(high - low, 1e-12) / 255
        self.low = len(centres) * (low + self.step / 2)

    def residuals(self, codes: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Lengths of what the codes leave of each unit vector."""
        both = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)
        left = _padded(vectors / norms[:, None]) - self.centres[np.arange(both.shape[1]), both]
        return np.sqrt((left * left).sum(axis=(1, 2)))

    def scan(self, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores of the best of a block, whose rows ascend by id.

        least: for each query a score that k vectors have already reached; lower ones are not looked for.
        """
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        n = len(ids)
        take = min(self.rerank + 1, n)
        lost = self.residuals(codes, vectors, norms)
        out = []
        for a in range(0, len(self.ids), QUERIES_AT_ONCE):
            own = slice(a, a + QUERIES_AT_ONCE)
            sums = np.zeros((len(self.ids[own]), n), np.int32)
            for table, column in zip(self.tables[:, own], codes.T, strict=True):
                sums += table[:, column]
            # The place in the block breaks ties, the smaller id first.
            key = sums.astype(np.int64) * n + np.arange(n - 1, -1, -1)
            best = np.argpartition(key, n - take, axis=1)[:, n - take :] if take < n else np.broadcast_to(np.arange(n), (len(sums), n))
            scores = (vectors[best] * self.vectors[own][:, None, :]).sum(axis=2) / (self.norms[own][:, None] * norms[best])
            scores = np.where(ids[best] == self.ids[own][:, None], -np.inf, scores)
            last = -np.sort(-scores, axis=1)[:, self.k - 1] if take >= self.k else np.full(len(scores), -np.inf)
            if least is not None:
                last = np.maximum(last, least[own])
            # Whatever could reach the k-th best score is ranked too; SLACK is for rounding.
            last = last[:, None] - SLACK
            open_ = self.low[own][:, None] + self.step[own][:, None] * sums + lost >= last
            columns = np.flatnonzero(open_.any(axis=0))
            near = (self.vectors[own] / self.norms[own][:, None]) @ (vectors[columns] / norms[columns][:, None]).T
            near = open_[:, columns] & (near >= last)
            for q, hit in zip(range(a, a + len(near)), near, strict=True):
                rows = columns[hit]
                rows = rows[ids[rows] != self.ids[q]]
                score = (vectors[rows] * self.vectors[q]).sum(axis=1) / (self.norms[q] * norms[rows])
                order = np.lexsort((ids[rows], -score))[: self.k]
                out.append((np.full(len(order), q), ids[rows[order]], score[order]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Best:
    """The k best of each query over the blocks so far."""

    def __init__(self, own: Scanner):
        self.own = own
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(own.ids), -np.inf)

    def add(self, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray) -> None:
        query, found, score = (np.concatenate(x) for x in zip(self.rows, self.own.scan(ids, codes, vectors, self.least), strict=True))
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        kept = rank < self.own.k
        self.rows = query[kept], found[kept], score[kept]
        full = rank == self.own.k - 1
        self.least[query[full]] = score[full]


def usable(vector: Column) -> Column:
    """Whether all components are finite and one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring the largest component of each to 0.5 up to 1; cosines stay what they are."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def _index(centres: np.ndarray):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                vectors = scaled(_matrix(batch.column(1)))
                unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
                packed = _pack(codes_of(unit, centres))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in packed], pa.binary()), pa.FixedSizeListArray.from_arrays(vectors.ravel(), vectors.shape[1]).cast(pa.list_(pa.float64()))], ["vec_id", "code", "vector"])

    return index


@lru_cache(1)
def _scanner(blob: bytes) -> Scanner:
    return Scanner(*pickle.loads(blob))


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = Best(_scanner(shared.value)), []
        for batch in batches:
            kept += [batch.slice(a, BLOCK) for a in range(0, len(batch), BLOCK)]
            if sum(map(len, kept)) >= BLOCK:
                _add(own, kept)
                kept = []
        if kept:
            _add(own, kept)
        query, found, score = own.rows
        yield pa.RecordBatch.from_arrays([pa.array(own.own.ids[query], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    return scan


def _add(own: Best, kept: list[pa.RecordBatch]) -> None:
    table = pa.Table.from_batches(kept).combine_chunks()
    ids = table.column(0).to_numpy()
    if not len(ids):
        return
    order = np.argsort(ids, kind="stable")
    codes = np.frombuffer(b"".join(table.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
    vectors = _matrix(table.column(2).combine_chunks() if isinstance(table.column(2), pa.ChunkedArray) else table.column(2))
    own.add(ids[order], codes[order], vectors[order])


def _nearest_of_length(rows: DataFrame, count: int, is_query: Column, k: int, rerank: int) -> list[DataFrame]:
    """The k best of each task, for vectors of one length."""
    spark = rows.sparkSession
    share = min(1.0, SAMPLE_ROWS / count)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("vec_id", "vector").collect()
    sample = scaled(np.array(sorted((r["vec_id"], *r["vector"]) for r in sample or rows.select("vec_id", "vector").take(1)), float)[:, 1:])
    centres = fit_centres(sample / np.sqrt((sample * sample).sum(axis=1))[:, None])
    index = rows.select("vec_id", "vector").mapInArrow(_index(centres), "vec_id long, code binary, vector array<double>").checkpoint()
    queries = index.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")).checkpoint()
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = []
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == block).collect()
        if own:
            own.sort(key=lambda r: r["vec_id"])
            args = (np.array([r["vec_id"] for r in own], np.int64), np.array([r["vector"] for r in own]), centres, k, rerank)
            found.append(index.mapInArrow(_scan(spark.sparkContext.broadcast(pickle.dumps(args))), "query_id long, vec_id long, score double"))
    return found


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k nearest by cosine of each row where is_query holds.

    is_query is a condition on vec_id, as the id is called here.
    """
    from stratagrid.session import shared_folder

    spark = vectors.sparkSession
    shared_folder(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries")).orderBy("d").collect()
    found = [x for r in sizes if r["queries"] for x in _nearest_of_length(rows.where(F.size("vector") == r["d"]), r["n"], is_query, k, rerank)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all."""
    from stratagrid.session import load

    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
