"""SimHash near-duplicate groups (operator 2).

A fingerprint has a bit set where over half of the XXH64 hashes of a text's
word shingles have it set. Fingerprints within a Hamming distance are linked
and the links' connected components are the groups.

Links come from pigeonhole blocks: 64 bits cut into b blocks leave two
fingerprints that differ in at most d bits with b - d equal blocks at least,
so each distinct fingerprint goes under every choice of b - d blocks, and
only fingerprints under one key are compared. b grows with the number of
distinct fingerprints until a key has as many bits as that number, so runs
under one key stay short; the links found are the same for any b.

Exact copies collapse to one fingerprint before any of this (partial
aggregation). Runs of one key stream through a task sorted; a long run (a
group of near copies) is searched breadth first: whatever is reached leaves
the run, so a dense group costs about one pass for each member still
unreached and yields a spanning tree, never all its pairs.

A key of more than SPLIT_RUN fingerprints is split by the pigeonhole once
more: its fingerprints differ in the other blocks alone, so of the bits there,
cut into d + 1 pieces, two that are near have a piece in common. Each goes
under its d + 1 pieces, which are keys of their own in other tasks. This loses
no link, and no task gets all of a hot key.

Edge cases: null and blank texts have fingerprint zero and link like any
other. Rows that repeat a doc_id count as documents of that id. Rows whose
doc_id is null get a fingerprint and the component of that fingerprint, if
any row with an id has it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import LOWER, as_bytes, by_slices, texts
from stratagrid.operators.components import connected_components

SEED = 42
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Shingles that are hashed at once, which bounds the memory a long text takes.
SHINGLES_AT_ONCE = 1 << 16
#: Runs up to this length are compared by shifted arrays, longer ones breadth first.
SHORT_RUN = 24
#: Fingerprints under one key beyond which the key is split.
SPLIT_RUN = 20_000


def fingerprint(text: bytes | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text; zero without a word."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_in_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - words_in_shingle + 1]
    ends = ends[words_in_shingle - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), SHINGLES_AT_ONCE):
        spans = zip(starts[k : k + SHINGLES_AT_ONCE].tolist(), ends[k : k + SHINGLES_AT_ONCE].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.dtype("<u8"))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = np.flatnonzero(counts * 2 > len(starts))
    return sum(1 << int(i) for i in ones)


def fingerprint_column(words_in_shingle: int = SHINGLE_WORDS):
    """A column function from text to the fingerprint as a long."""

    def work(column: pa.Array) -> pa.Array:
        prints = np.array([fingerprint(t, words_in_shingle) for t in as_bytes(column)], np.uint64)
        return pa.array(prints.view(np.int64), pa.int64())

    run = by_slices(work)

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        return run(column)

    return of


def block_count(distinct: int, distance: int = MAX_DISTANCE) -> int:
    """The fewest blocks whose keys have at least as many bits as log2(distinct)."""
    for blocks in range(distance + 1, 2 * distance + 1):
        if 64 * (blocks - distance) // blocks >= np.log2(max(2, distinct)):
            return blocks
    return 2 * distance


def block_keys(value: Column, blocks: int, distance: int = MAX_DISTANCE) -> Column:
    """An array of keys, one for each choice of blocks - distance blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).cast("short").alias("choice"), value.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def piece_masks(blocks: int, distance: int = MAX_DISTANCE) -> list[list[int]]:
    """For each choice of blocks the masks (signed) of the distance + 1 pieces of the bits that it leaves."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - distance):
        rest = [b for i in range(blocks) if i not in chosen for b in range(edges[i], edges[i + 1])]
        masks = [sum(1 << b for b in rest[len(rest) * k // (distance + 1) : len(rest) * (k + 1) // (distance + 1)]) for k in range(distance + 1)]
        out.append([m - (1 << 64) if m >= 1 << 63 else m for m in masks])
    return out


def split_runs(keyed: DataFrame, blocks: int, distance: int, longest: int) -> DataFrame:
    """keyed (choice, bits, fingerprint, first_id) with piece and piece_bits, which are null but in the rows of keys that are too long."""
    long_ = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > longest).select("choice", "bits", F.lit(True).alias("long"))
    masks = F.array(*[F.array(*[F.lit(m) for m in own]) for own in piece_masks(blocks, distance)])
    pieces = F.transform(F.get(masks, F.col("choice").cast("int")), lambda m, k: F.struct(k.alias("piece"), F.col("fingerprint").bitwiseAND(m).alias("piece_bits")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("piece"), F.lit(None).cast("long").alias("piece_bits")))
    both = keyed.join(long_, ["choice", "bits"], "left").withColumn("p", F.explode(F.when(F.col("long"), pieces).otherwise(whole)))
    return both.select("choice", "bits", "p.piece", "p.piece_bits", "fingerprint", "first_id")


def _short_links(run: np.ndarray, prints: np.ndarray, ids: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    found = []
    for step in range(1, SHORT_RUN):
        same = np.flatnonzero(run[step:] == run[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(prints[same] ^ prints[same + step]) <= distance]
        found.append((ids[near], ids[near + step]))
    return found


def _long_links(prints: np.ndarray, ids: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    found = []
    while len(prints):
        front, prints, ids = [(prints[0], ids[0])], prints[1:], ids[1:]
        while front and len(prints):
            value, name = front.pop()
            near = np.bitwise_count(prints ^ value) <= distance
            if near.any():
                found.append((np.full(int(near.sum()), name), ids[near]))
                front += zip(prints[near], ids[near], strict=True)
                prints, ids = prints[~near], ids[~near]
    return found


def run_links(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray, distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that span, within each run of equal keys, what the distance connects."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    short = np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths)
    run = np.repeat(np.arange(len(starts)), lengths)
    found = _short_links(run[short], prints[short], ids[short], distance)
    for k in np.flatnonzero(lengths > SHORT_RUN):
        part = slice(starts[k], starts[k] + lengths[k])
        found += _long_links(prints[part], ids[part], distance)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _link_batches(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            piece, piece_bits = (pc.fill_null(batch.column(i), -1 if i == 2 else 0) for i in (2, 3))
            columns = [batch.column(0), batch.column(1), piece, piece_bits, batch.column(4), batch.column(5)]
            choice, bits, piece, piece_bits, prints, ids = (c.to_numpy(zero_copy_only=False) for c in columns)
            keys = np.rec.fromarrays([choice, bits, piece, piece_bits])
            now = [keys, prints, ids] if rest is None else [np.concatenate(x) for x in zip(rest, (keys, prints, ids), strict=True)]
            if not len(now[0]):
                continue
            # The last run may go on in the next batch.
            cut = len(now[0]) - int((now[0] == now[0][-1])[::-1].argmin()) if (now[0] != now[0][-1]).any() else 0
            yield _linked(*(x[:cut] for x in now), distance)
            rest = [x[cut:] for x in now]
        if rest is not None:
            yield _linked(*rest, distance)

    return link


def _linked(keys, prints, ids, distance) -> pa.RecordBatch:
    if not len(keys):
        a = b = np.zeros(0, np.int64)
    else:
        a, b = run_links(keys, prints.view(np.uint64), ids, distance)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], ["src", "dst"])


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_in_shingle: int = SHINGLE_WORDS,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """Columns doc_id, fingerprint (long), component_id (the smallest doc_id of the group)."""
    prints = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(words_in_shingle)("text").alias("fingerprint"))
    return components_of(prints, distance)


def components_of(prints: DataFrame, distance: int = MAX_DISTANCE, longest: int = SPLIT_RUN) -> DataFrame:
    """near_duplicates from a table of doc_id and fingerprint."""
    from stratagrid.session import shared_folder

    shared_folder(prints.sparkSession)
    prints = prints.checkpoint()
    distinct = prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")).checkpoint()
    count = distinct.count()
    blocks = block_count(count, distance)
    keyed = distinct.select(F.explode(block_keys(F.col("fingerprint"), blocks, distance)).alias("k"), "fingerprint", "first_id").select("k.choice", "k.bits", "fingerprint", "first_id")
    if count > longest:
        keyed = split_runs(keyed, blocks, distance, longest)
    else:
        # No key can have more than all fingerprints.
        keyed = keyed.select("choice", "bits", F.lit(None).cast("int").alias("piece"), F.lit(None).cast("long").alias("piece_bits"), "fingerprint", "first_id")
    key = ["choice", "bits", "piece", "piece_bits"]
    dealt = keyed.repartition(*key).sortWithinPartitions(*key, "fingerprint")
    links = dealt.mapInArrow(_link_batches(distance), "src long, dst long")
    roots = connected_components(links)
    classes = distinct.join(roots, distinct.first_id == roots.node, "left").select(
        "fingerprint", F.coalesce("root", "first_id").alias("component_id")
    )
    return prints.join(classes, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint in hex and its component."""
    from stratagrid.session import load

    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
