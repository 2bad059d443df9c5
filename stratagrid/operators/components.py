"""Connected components of an undirected graph, as label tables.

Edges are first contracted where they lie: a task labels the pieces of CHUNK
edges at a time, in arrays, and hands on each node with its piece. Nodes that
came in several pieces link these, and only such links go on, so edges that
lie together (a mesh by bands of rows) leave few of them. What fits one chunk
is settled by one task; what doesn't goes on in rounds.

Rounds are alternating stars: every round first links the larger neighbours
of a node to its smallest neighbour, then its smaller ones. Rounds grow with
the logarithm of the longest path, each is two shuffles of the edge list, and
edges never outnumber the input. A node with very many neighbours is one
side of a sort-merge join, which adaptive execution splits.

Nodes that are not integers are not contracted, they take rounds alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from stratagrid.session import shared_folder

#: Edges that a task contracts at once.
CHUNK = 1 << 20


def _pieces(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges, and for each the least that it reaches."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    root = np.arange(len(nodes))
    while len(a):
        # The larger of two roots hangs below the smaller one; then every node points at its root.
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[root]


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """Columns node, root: for each node of a chunk of edges the least that it reaches there."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            nodes, roots = _pieces(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n >= chunk:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return edges.mapInArrow(contract, "node long, root long")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("src", "dst")).alias("x"),
    ).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """Columns node, root: the smallest node that each endpoint of an edge reaches.

    Edges with a null end, loops and repeated edges don't change the result;
    without any edge between two nodes the result is empty. Nodes must be of
    one orderable type.
    """
    shared_folder(edges.sparkSession)
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> dst")
    kind = pairs.select(F.greatest("src", "dst").alias("k")).schema["k"].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return _by_stars(pairs, max_rounds)
    pieces = _contracted(pairs.select(*[F.col(c).cast("long").alias(c) for c in ("src", "dst")]), chunk).checkpoint()
    found = pieces.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).checkpoint()
    # A node of two pieces links them; one of more is looked up in the pieces again.
    several = found.where("low <> high")
    links = several.select(F.col("high").alias("src"), F.col("low").alias("dst"))
    if not found.where("n > 2 and low <> high").isEmpty():
        many = several.where("n > 2").select("node", "low")
        links = links.unionByName(pieces.join(many, "node").where("root <> low").select(F.col("root").alias("src"), F.col("low").alias("dst")))
    links = links.distinct().checkpoint()
    count = links.count()
    if count:
        if count <= chunk:
            whole = _contracted(links.coalesce(1), chunk)
        else:
            whole = _by_stars(links, max_rounds)
        found = found.join(whole.select(F.col("node").alias("low"), F.col("root").alias("top")), "low", "left")
        found = found.select("node", F.coalesce("top", "low").alias("root"))
    else:
        found = found.select("node", F.col("low").alias("root"))
    return found.select(*[F.col(c).cast(kind).alias(c) for c in ("node", "root")])


def _by_stars(pairs: DataFrame, max_rounds: int) -> DataFrame:
    """Columns node, root of edges src, dst between two nodes, in rounds of alternating stars."""
    now = pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct().checkpoint()
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        lowest = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        larger = (
            both.where("dst > src").join(lowest, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        )
        lowest = larger.groupBy("src").agg(F.min("dst").alias("low"))
        rest = larger.join(lowest, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        now = lowest.select("src", F.col("low").alias("dst")).unionByName(rest).distinct().checkpoint()
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled edges are stars: every node but a root points at its root.
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
