"""Benchmark decontamination (operator 4): Wu-Manber search for item windows.

A window is ten consecutive words of a benchmark item, or a shorter item as
a whole. Words of windows get numbers, all other words number 0, so a text is
a row of numbers and comparing numbers is comparing words. The search is
Wu-Manber's over those numbers: a shift table indexed by hashed blocks of two
words says how far a position can jump without missing a window, positions
with shift 0 look up the windows that end in the same block (suffix-hash
buckets), and comparing the words confirms or refutes each. A text is cut
into lanes whose cursors jump at the same time, so the loop is over jumps of
a lane and each step is a numpy operation on all lanes.

The benchmark's size is checked before its windows are broadcast: it is cut
into blocks of at most BLOCK_WORDS words. Documents pass through one column
function for each HELD_BLOCKS blocks, which a worker keeps loaded; there, texts
are split into words once and searched for one block after the other. A later
function adds to the spans that the former ones found.

Edge cases: null texts have no words, null or wordless items no window.
Items that repeat an item_id count as one item with all their windows. Rows
of documents are handled one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import as_bytes, row_slices, texts

WINDOW_WORDS = 10
#: Words of benchmark items in one broadcast block, and blocks that a worker keeps loaded (about 100 MB each when full).
BLOCK_WORDS = 1_000_000
HELD_BLOCKS = 8
#: Positions in a lane.
LANE = 256
#: Bits of a block's hash.
HASH_BITS = 20

#: A-Z to a-z, other ASCII but digits and letters to a blank, bytes of other characters kept.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SPANS = "struct<n_words: bigint, spans: array<struct<start: bigint, stop: bigint>>, items: array<string>>"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def _block_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Matcher:
    """The tables for windows of one length."""

    def __init__(self, windows: np.ndarray, items: np.ndarray, item_starts: np.ndarray):
        """windows: one row of word numbers each, all different; items: those of each window, from its start to the next."""
        self.length = windows.shape[1]
        self.block = min(2, self.length)
        self.windows = windows
        self.items, self.item_starts = items, item_starts
        self.shift = np.full(1 << HASH_BITS, self.length - self.block + 1, np.int16)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self._hash(windows[:, end - self.block + 1], windows[:, end]), self.length - 1 - end)
        suffix = self._hash(windows[:, -self.block], windows[:, -1])
        order = np.argsort(suffix, kind="stable")
        self.order, suffix = order, suffix[order]
        self.buckets = np.flatnonzero(np.r_[True, suffix[1:] != suffix[:-1]])
        self.bucket_hash = suffix[self.buckets]
        self.bucket_size = np.diff(np.r_[self.buckets, len(suffix)])

    def _hash(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return _block_hash(left if self.block == 2 else np.zeros_like(right), right)

    def items_of(self, window: int) -> list[int]:
        return self.items[self.item_starts[window] : self.item_starts[window + 1]].tolist()

    def search(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End positions and windows of all occurrences."""
        ends = self._unskipped(numbers)
        if not len(ends):
            return ends, ends
        found = self._hash(numbers[ends - self.block + 1], numbers[ends])
        bucket = np.minimum(np.searchsorted(self.bucket_hash, found), len(self.bucket_hash) - 1)
        known = self.bucket_hash[bucket] == found
        ends, bucket = ends[known], bucket[known]
        sizes = self.bucket_size[bucket]
        at = np.repeat(ends, sizes)
        offset = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        window = self.order[np.repeat(self.buckets[bucket], sizes) + offset]
        for k in range(self.length):
            if not len(at):
                break
            same = numbers[at - self.length + 1 + k] == self.windows[window, k]
            at, window = at[same], window[same]
        return at, window

    def _unskipped(self, numbers: np.ndarray) -> np.ndarray:
        """Positions where the shift table leaves a window's end possible."""
        cursor = np.arange(self.length - 1, len(numbers), LANE)
        stop = np.minimum(cursor + LANE, len(numbers))
        kept = []
        while len(cursor):
            jump = self.shift[self._hash(numbers[cursor - self.block + 1], numbers[cursor])]
            kept.append(cursor[jump == 0])
            cursor = cursor + np.maximum(jump, 1)
            on = cursor < stop
            cursor, stop = cursor[on], stop[on]
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)


class Windows:
    """All windows of a block of benchmark items."""

    def __init__(self, rows: list[tuple[str, bytes | None]]):
        self.number: dict[bytes, int] = {}
        split = [(item_id, words_of(text)) for item_id, text in rows]
        split = [(item_id, words) for item_id, words in split if words]
        self.item_ids = list(dict.fromkeys(item_id for item_id, _ in split))
        place = {item_id: k for k, item_id in enumerate(self.item_ids)}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, words in split:
            numbers = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words), np.int32, len(words))
            by_length[min(WINDOW_WORDS, len(words))].append((numbers, place[item_id]))
        self.matchers = [_matcher(size, own) for size, own in sorted(by_length.items())]

    def find(self, words: list[bytes], first: np.ndarray, counts: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For texts with occurrences their merged spans of words and the items.

        words: those of all texts, with an empty one after each text; first: where each text begins.
        """
        # An empty word and one that no window has are 0; no window crosses from one text to the next.
        numbers = np.fromiter(map(self.number.get, words, _ZEROS), np.int32, len(words))
        hit: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for matcher in self.matchers:
            ends, windows = matcher.search(numbers)
            owner = np.searchsorted(first, ends, "right") - 1
            for k, end, window in zip(owner.tolist(), ends.tolist(), windows.tolist(), strict=True):
                spans, items = hit.setdefault(k, ([], set()))
                stop = end - int(first[k]) + 1
                spans.append((stop - matcher.length, stop))
                items.update(self.item_ids[i] for i in matcher.items_of(window))
        return {k: (merged(spans), items) for k, (spans, items) in hit.items()}


def _matcher(size: int, own: list[tuple[np.ndarray, int]]) -> Matcher:
    """The different windows of one length, and the items that hold each."""
    rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(numbers, size) for numbers, _ in own])
    owner = np.concatenate([np.full(len(numbers) - size + 1, item, np.int32) for numbers, item in own])
    windows, at = np.unique(rows, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([at.ravel(), owner], axis=1), axis=0)
    return Matcher(windows, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)))


def split_words(rows: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of all texts with an empty one after each, where each text begins, and their counts."""
    counts, words = np.zeros(len(rows), np.int64), []
    for k, text in enumerate(rows):
        own = words_of(text)
        counts[k] = len(own)
        words += own
        words.append(b"")
    return words, np.cumsum(counts + 1) - counts - 1, counts


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZEROS = _Zeros()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _search_column(shared: list):
    """A column function (text, what former ones found) to what is found with these blocks."""

    @F.arrow_udf(SPANS)
    def search(text: pa.Array, before: pa.Array) -> pa.Array:
        blocks, out = [_unpickled(x.value) for x in shared], []
        known = before.to_pylist()
        for a, b in row_slices(text):
            words, first, counts = split_words(as_bytes(text.slice(a, b - a)))
            hits = [w.find(words, first, counts) for w in blocks]
            for k in range(b - a):
                spans, items = [], set()
                for hit in hits:
                    if k in hit:
                        spans += hit[k][0]
                        items |= hit[k][1]
                if (old := known[a + k]) is not None:
                    spans += [(x["start"], x["stop"]) for x in old["spans"]]
                    items |= set(old["items"])
                out.append({"n_words": int(counts[k]), "spans": [{"start": s, "stop": e} for s, e in merged(spans)], "items": sorted(items)})
        return pa.array(out, _FOUND)

    return search


@lru_cache(HELD_BLOCKS)
def _unpickled(blob: bytes) -> Windows:
    """One copy of the tables in a worker, for each block."""
    return pickle.loads(blob)


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS):
    """Yields blocks of items, each with at most about block_words words (blanks are counted)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("text is not null and item_id is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        yield [(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()]


def with_findings(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "found", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with one more column: the number of words, the spans of hit words and the items that occur."""
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(pickle.dumps(Windows(rows))) for rows in item_blocks(benchmark, block_words=block_words)]
    out = docs.withColumn(name, F.lit(None).cast(SPANS))
    for k in range(0, len(shared), HELD_BLOCKS):
        out = out.withColumn(name, _search_column(shared[k : k + HELD_BLOCKS])(F.col(text_col), F.col(name)))
    return out


def hit_words(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    found = with_findings(texts(docs, id_col, text_col), benchmark)
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit_words(F.col("found")).alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
        F.col("found.spans").alias("spans"),
        F.col("found.items").alias("items"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    from stratagrid.session import load

    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), dw AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
