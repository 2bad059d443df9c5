"""Token ids in a content-addressed store (operator 5).

Layout of a store (a folder; all files are Parquet, written by Spark):

  chunks/    digest, data: each different chunk of ids once. data holds the
             ids little-endian, 2 bytes each if the vocabulary has at most
             65,536 ids, else 4; digest is BLAKE2b-128 of data.
  recipes/   doc_id, start, n_tokens, chunks, lengths, root: one row for each
             document in ascending doc_id order (nulls first), in files of
             ascending ranges. root is the Merkle root of the chunk digests.
  manifest/  part, documents, tokens, root: a row for each recipe file with
             the Merkle root of its documents' roots, in order, and part -1
             for the store with the root over the parts' roots.

Documents are cut where a rolling hash of the last WINDOW ids has its lowest
bits zero, or after MOST_IDS ids, so equal passages give equal chunks wherever
they stand. A task keeps only the first copy of a chunk; what is left is dealt
by digest, so a chunk that a third of all documents share arrives at most once
from each task. Texts are encoded with the tokenizers library; as none of its
pieces spans white space, each distinct word of a slice is encoded once, and
without the punctuation behind it, whose ids follow. As the tokenizer lower-cases
texts, A-Z are lower-cased before words are told apart, but not in slices where
that could change more: those that spell a special token in any case, or hold
combining marks that compose with small letters alone. Words that the
tokenizer's normalizer leaves as they are skip it.

Reading back verifies the whole chain: every chunk's digest from its ids,
every recipe's root from the digests, the roots and counts of every recipe
file and of the store from the recipes, in their order. A chunk that is
missing, a chunk that has other ids or another length, a recipe that was
changed, added, moved or left out: each raises an error, no row is lost.
Documents' CRCs need no ids to be moved: the CRC of a chunk is moved by the
zeros that follow it in the document (a matrix over GF(2)) and the chunks'
parts are combined by exclusive or. read_documents gives the ids themselves.

Edge cases: null and empty texts are documents with the end id alone. Rows
that repeat a doc_id are documents of their own, in the order of their roots.
Text that spells a special token has that token's id, as in the library. An
empty table gives a store without documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagrid.llm.common import LOWER, SLICE_BYTES, row_slices, texts
from stratagrid.session import fresh_path, load

END_ID = 1
WINDOW = 8
#: A chunk ends at a place in CUT_EVERY on average.
CUT_EVERY = 256
MOST_IDS = 1024
#: Words that a worker keeps encoded.
KEPT_WORDS = 600_000
#: Bytes of chunks in one store partition, about.
PART_BYTES = 32 << 20

_LETTERS, _SMALL, _MARKS = "[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ]", "[a-zß-öø-ÿ]", "[.,!?;:|*#$%&-]"
#: Forms of words that have one piece, or two, between the ends that their ids show, and whether the normalizer leaves them as they are.
_FORMS = ((1, True, f"^{_SMALL}+$"), (2, True, f"^{_SMALL}+{_MARKS}+$"), (1, False, f"^{_LETTERS}+$"), (2, False, f"^{_LETTERS}+{_MARKS}+$"))
#: A word of letters and one more character, which is a piece of its own.
_TAILED = f"^{_LETTERS}+{_MARKS}$"
_BLANKS = bytes(32 if b in b"\t\n\r " else b for b in range(256))
_SMALL_BLANKS = _BLANKS.translate(LOWER)
#: Normalizers in whose results A-Z that are lower-cased before differ by nothing but what _small watches for.
_LOWERING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts word by word and remembers words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [x["content"].lower().encode() for x in spec["added_tokens"]]
        self.lowers = spec["normalizer"] == _LOWERING
        self.normalizer = self.tokenizer.normalizer
        self.bare = Sequence([]) if self.lowers else self.normalizer
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.closes = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.closes[i] = piece.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, f"<u{self.width}")
        #: Where the ids of each word end; the word with number 0 has none.
        self.ends = np.zeros(1, np.int64)

    def _ids_of(self, words: pa.Array, count: int, bare: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and sizes of words that have count pieces each, None if the ids don't show that."""
        if bare:
            self.tokenizer.normalizer = self.bare
        try:
            encoded = self.tokenizer.encode_batch_fast([_joined(words)], add_special_tokens=False)[0]
        finally:
            if bare:
                self.tokenizer.normalizer = self.normalizer
        ids = np.array(encoded.ids, np.int64)
        ends = np.flatnonzero(self.closes[ids])[count - 1 :: count] + 1
        return (ids, np.diff(np.r_[0, ends])) if len(ends) == len(words) and ends[-1] == len(ids) else None

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Encodes distinct words that are not yet remembered; their numbers from now on."""
        rest, at, found = words, np.arange(len(words)), []
        for count, bare, form in _FORMS:
            fits = pc.match_substring_regex(rest, form)
            on = fits.to_numpy(zero_copy_only=False)
            plain, rest = rest.filter(fits), rest.filter(pc.invert(fits))
            own, at = at[on], at[~on]
            for k in range(0, len(plain), 20_000):
                part = plain.slice(k, 20_000)
                if (got := self._ids_of(part, count, bare)) is None:
                    rest, at = pa.concat_arrays([rest, part]), np.r_[at, own[k : k + 20_000]]
                else:
                    found.append((own[k : k + 20_000], *got))
        for k in range(0, len(rest), 20_000):
            part = rest.slice(k, 20_000)
            rows = [x.ids for x in self.tokenizer.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            found.append((at[k : k + 20_000], np.fromiter((i for row in rows for i in row), np.int64, int(sizes.sum())), sizes))
        number = np.empty(len(words), np.int64)
        number[np.concatenate([own for own, _, _ in found])] = np.arange(len(self.ends), len(self.ends) + len(words))
        self.ids = np.concatenate([self.ids, *[ids.astype(self.ids.dtype) for _, ids, _ in found]])
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(np.concatenate([sizes for _, _, sizes in found]))]
        return number

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and where each text ends."""
        if len(self.place) > KEPT_WORDS:
            self._forget()
        lists = pc.split_pattern(_blanked(column, self._small), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        table, stops = self._table(coded.dictionary)
        # The end id is one more word, behind each text's words.
        table, stops = np.append(table, np.array([end_id], table.dtype)), np.append(stops, len(table) + 1)
        last = np.cumsum(counts)
        words = np.insert(coded.indices.to_numpy(zero_copy_only=False), last, len(stops) - 1)
        sizes = np.diff(stops, prepend=0)[words]
        total = np.cumsum(sizes)
        places = np.repeat((stops[words] - total), sizes)
        places += np.arange(len(places))
        return table[places], total[last + np.arange(len(last))]

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of some distinct words, one behind the other, and where each word's ids end."""
        tailed = pc.match_substring_regex(words, _TAILED)
        split, on = words.filter(tailed), tailed.to_numpy(zero_copy_only=False)
        parts = pa.concat_arrays([pc.if_else(tailed, "", words), pc.utf8_slice_codeunits(split, 0, -1), pc.utf8_slice_codeunits(split, -1)]).dictionary_encode()
        number = self._numbers(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)]
        n, m = len(words), len(split)
        # Two parts a word, of which the second may be the empty word.
        both = np.zeros((n, 2), np.int64)
        both[:, 0] = number[:n]
        both[on, 0], both[on, 1] = number[n : n + m], number[n + m :]
        both = both.ravel()
        sizes = np.diff(self.ends, prepend=0)[both]
        total = np.cumsum(sizes)
        places = np.repeat(self.ends[both] - total, sizes)
        places += np.arange(len(places))
        return self.ids[places], total[1::2]

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """The numbers of words, which are encoded if they are new."""
        names = _joined(distinct).split(" ") if len(distinct) else []
        number = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = number < 0
        if new.any():
            number[new] = self._learn(distinct.filter(pa.array(new)))
            self.place.update(zip(compress(names, new.tolist()), number[new].tolist(), strict=True))
        return number

    def _small(self, data: bytes) -> bytes:
        """data with ASCII white space as blanks and A-Z as a-z, if the tokenizer gives the same ids for that."""
        if self.lowers and b"\xcc" not in data and b"\xcd" not in data:
            small = data.translate(_SMALL_BLANKS)
            if not any(x in small for x in self.specials):
                return small
        return data.translate(_BLANKS)


def _joined(words: pa.Array) -> str:
    """Words without blanks as one text with a blank between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()


def _blanked(column: pa.Array, blanks: Callable[[bytes], bytes]) -> pa.Array:
    """The texts with ASCII white space as blanks, nulls as empty texts."""
    column = pc.fill_null(column.cast(pa.string()), "")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    data = data.to_pybytes()[at[0] : at[-1]] if data is not None else b""
    return pa.StringArray.from_buffers(len(column), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(blanks(data)))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _weights() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)


_WEIGHTS = _weights()


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the chunks of documents end, which themselves end at ends."""
    mixed = _WEIGHTS[ids.astype(np.int64) & 0xFFFF]
    rolled = np.zeros(len(ids), np.uint64)
    for k in range(min(WINDOW, len(ids))):
        rolled[k:] += mixed[: len(ids) - k] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    found = np.flatnonzero(rolled >> np.uint64(32) & np.uint64(CUT_EVERY - 1) == 0) + 1
    # A window must lie within its document.
    owner = np.searchsorted(ends, found)
    found = found[found - np.r_[0, ends[:-1]][owner] >= WINDOW]
    found = np.unique(np.r_[found, ends])
    starts = np.r_[0, found[:-1]]
    if (long := found - starts > MOST_IDS).any():
        found = np.unique(np.concatenate([found, *[np.arange(a + MOST_IDS, b, MOST_IDS) for a, b in zip(starts[long], found[long], strict=True)]]))
    return found


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary tree; a node without a sibling goes up as it is."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


_STAGED = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("chunks", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("root", pa.binary()), ("digest", pa.binary()), ("data", pa.binary())])


def _stage(path: str, end_id: int):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for a, b in row_slices(batch.column(1), 2 * SLICE_BYTES):
                yield _staged(batch.slice(a, b - a), encoder(path), end_id, seen)

    return stage


def _staged(part: pa.RecordBatch, own: Encoder, end_id: int, seen: set[bytes]) -> pa.RecordBatch:
    """A recipe for each row of part, and its chunks that seen doesn't hold."""
    ids, ends = own.encode(part.column(1), end_id)
    stops = cuts(ids, ends)
    raw, names, fresh = ids.tobytes(), [], []
    at = [0, *(stops * own.width).tolist()]
    for x, y in zip(at[:-1], at[1:], strict=True):
        name = digest(data := raw[x:y])
        names.append(name)
        if name not in seen:
            seen.add(name)
            fresh.append((name, data))
    last = np.searchsorted(stops, ends) + 1
    offsets = np.r_[0, last].astype(np.int32)
    roots = [merkle_root(names[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    n, m = len(roots), len(fresh)
    lists = np.r_[offsets, np.full(m, offsets[-1])].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["recipe"] * n + ["chunk"] * m),
            pa.concat_arrays([part.column(0), pa.nulls(m, pa.int64())]),
            pa.ListArray.from_arrays(pa.array(lists), pa.array(names, pa.binary())),
            pa.ListArray.from_arrays(pa.array(lists), pa.array(np.diff(np.r_[0, stops]).astype(np.int32))),
            pa.array(roots + [None] * m, pa.binary()),
            pa.array([None] * n + [x for x, _ in fresh], pa.binary()),
            pa.array([None] * n + [x for _, x in fresh], pa.binary()),
        ],
        schema=_STAGED,
    )


def _first_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a digest that has not come before in this partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for name in batch.column(0).to_pylist():
            keep.append(name not in seen)
            seen.add(name)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _numbered(offsets: dict[int, int]):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for batch in batches:
            parts, counts = batch.column("part").to_pylist(), batch.column("n_tokens").to_pylist()
            starts = []
            for p, n in zip(parts, counts, strict=True):
                if p != part:
                    part, at = p, offsets[p]
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], [*batch.schema.names, "start"])

    return number


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A partition's roots are 32 bytes a document.
    roots: dict[int, list] = {}
    tokens: dict[int, int] = {}
    for batch in batches:
        for p, root, n in zip(batch.column("part").to_pylist(), batch.column("root").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
            roots.setdefault(p, []).append(root)
            tokens[p] = tokens.get(p, 0) + n
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(roots), pa.int32()), pa.array([len(x) for x in roots.values()], pa.int64()), pa.array([tokens[p] for p in roots], pa.int64()), pa.array([merkle_root(x) for x in roots.values()], pa.binary())],
        ["part", "documents", "tokens", "root"],
    )


MANIFEST = "part int, documents bigint, tokens bigint, root binary"


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs and writes a store to path, a folder that all executors reach."""
    from stratagrid.session import remove_path

    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()
    source = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "kind string, doc_id long, chunks array<binary>, lengths array<int>, root binary, digest binary, data binary"
    staged = f"{path}/staged"
    source.mapInArrow(_stage(tokenizer, end_id), schema).write.partitionBy("kind").option("compression", "zstd").parquet(staged)
    rows = spark.read.schema(schema).parquet(staged)
    size = rows.where("kind = 'chunk'").agg(F.sum(F.length("data"))).first()[0] or 0
    parts = max(1, int(size // PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = rows.where("kind = 'chunk'").select("digest", "data").repartition(parts, "digest").mapInArrow(_first_only, "digest binary, data binary")
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = rows.where("kind = 'recipe'").select("doc_id", "chunks", "lengths", "root")
    recipes = recipes.withColumn("n_tokens", F.aggregate("lengths", F.lit(0).cast("long"), lambda t, x: t + x))
    ordered = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id()).checkpoint()
    roots = ordered.select("part", "n_tokens", "root").mapInArrow(_part_roots, MANIFEST).orderBy("part").collect()
    totals = np.cumsum([0] + [r["tokens"] for r in roots]).tolist()
    offsets = {r["part"]: totals[k] for k, r in enumerate(roots)}
    fields = "doc_id long, chunks array<binary>, lengths array<int>, root binary, n_tokens long, part int, start long"
    ordered.mapInArrow(_numbered(offsets), fields).select("doc_id", "start", "n_tokens", "chunks", "lengths", "root", "part").write.option("compression", "zstd").parquet(f"{path}/recipes")
    whole = (-1, sum(r["documents"] for r in roots), totals[-1], merkle_root([bytes(r["root"]) for r in roots]))
    spark.createDataFrame([(r["part"], r["documents"], r["tokens"], bytes(r["root"])) for r in roots] + [whole], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    remove_path(spark, staged)


# CRC-32 over GF(2): what a CRC becomes when zeros follow.


def _shift_matrices() -> np.ndarray:
    """For each k the images of the 32 bits when 4 * 2**k zero bytes follow."""
    one = np.zeros(32, np.uint32)
    one[0] = 0xEDB88320
    one[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)
    now, out = one, []
    for _ in range(5):  # 1 bit to 32 bits
        now = _apply(now, now)
    for _ in range(48):
        out.append(now)
        now = _apply(now, now)
    return np.array(out)


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


_SHIFTS = _shift_matrices()


def moved(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    """CRCs as parts of the CRC of something that goes on for so many 4-byte ids."""
    out = crc.astype(np.uint32)
    for k in range(int(ids_after.max()).bit_length() if len(ids_after) else 0):
        on = np.flatnonzero(ids_after >> k & 1)
        out[on] = _apply(_SHIFTS[k], out[on])
    return out


def _read_chunks(width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, sums = [], [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest(data) != name:
                    raise ValueError(f"a chunk does not have its digest {name.hex()}")
                ids = np.frombuffer(data, f"<u{width}")
                names.append(name)
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["digest", "size", "crc"])

    return read


@F.arrow_udf(T.LongType())
def _moved_column(crc: pa.Array, ids_after: pa.Array) -> pa.Array:
    return pa.array(moved(crc.to_numpy(zero_copy_only=False), ids_after.to_numpy(zero_copy_only=False)).astype(np.int64), pa.int64())


_PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("digest", pa.binary()), ("length", pa.int64()), ("after", pa.int64())])


def _place_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with the ids that follow it in its document; wrong roots raise."""
    for batch in batches:
        doc_id, start, tokens, chunks, lengths, roots = (batch.column(k) for k in range(6))
        for root, names, n, parts in zip(roots.to_pylist(), chunks.to_pylist(), tokens.to_pylist(), lengths.to_pylist(), strict=True):
            if merkle_root(names) != root or sum(parts) != n or len(parts) != len(names):
                raise ValueError(f"a recipe does not have its root {root.hex()}")
        counts = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.repeat(np.arange(len(counts)), counts)
        flat = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        total = tokens.to_numpy(zero_copy_only=False)
        # What follows a chunk is the document's ids less all up to its end.
        before = np.r_[0, np.cumsum(total)[:-1]] if len(total) else total
        after = (before + total)[own] - np.cumsum(flat)
        take = pa.array(own)
        yield pa.RecordBatch.from_arrays([doc_id.take(take), start.take(take), tokens.take(take), chunks.flatten(), pa.array(flat), pa.array(after)], schema=_PLACES)


def document_sums(spark, path: str, width: int = 2) -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32, from the chunks as they are read; a missing or changed chunk raises."""
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "data").mapInArrow(_read_chunks(width), "digest binary, size long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "chunks", "lengths", "root")
    places = recipes.mapInArrow(_place_chunks, "doc_id long, start long, n_tokens long, digest binary, length long, after long")
    found = places.join(chunks, "digest", "left")
    wrong = F.raise_error(F.concat(F.lit("a chunk is missing or has another length: "), F.hex("digest"))).cast("long")
    crc = F.when(F.col("size") == F.col("length"), F.col("crc")).otherwise(wrong)
    moved_ = found.select("doc_id", "start", "n_tokens", _moved_column(crc, F.col("after")).alias("crc"))
    return moved_.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark, path: str, width: int = 2) -> DataFrame:
    """Columns doc_id, start, ids: the documents put together again; a missing chunk raises."""

    @F.arrow_udf("array<int>")
    def joined(parts: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b"".join(x["data"] for x in sorted(row, key=lambda x: x["k"])), f"<u{width}").tolist() for row in parts.to_pylist()], pa.list_(pa.int32()))

    chunks = spark.read.parquet(f"{path}/chunks")
    places = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("chunks").alias("k", "digest"))
    data = F.when(F.col("data").isNotNull(), F.col("data")).otherwise(F.raise_error(F.lit("a chunk is missing")).cast("binary"))
    rows = places.join(chunks, "digest", "left").groupBy("doc_id", "start").agg(F.collect_list(F.struct("k", data.alias("data"))).alias("parts"))
    return rows.select("doc_id", "start", joined("parts").alias("ids"))


def verify_manifest(spark, path: str) -> bool:
    """Whether the manifest's roots and counts follow from the recipes in their order, and each recipe starts where the one before ends.

    Each recipe's own root is checked where its chunks are read, see document_sums.
    """
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "start", "n_tokens", "root")
    ordered = recipes.repartition("part").sortWithinPartitions("part", "start")
    got = ordered.select("part", "n_tokens", "root").mapInArrow(_part_roots, MANIFEST).orderBy("part").collect()
    want = spark.read.parquet(f"{path}/manifest").orderBy("part").collect()
    whole = (-1, sum(r["documents"] for r in got), sum(r["tokens"] for r in got), merkle_root([bytes(r["root"]) for r in got]))
    # Starts are running sums, so their total follows from the order and the counts.
    firsts = {r["part"]: (r["a"], r["b"]) for r in recipes.groupBy("part").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("n_tokens")).alias("b")).collect()}
    at, joint = 0, True
    for r in got:
        joint &= firsts[r["part"]] == (at, at + r["tokens"])
        at += r["tokens"]
    return joint and [tuple(r) for r in want] == [whole, *[tuple(r) for r in got]]


def op5_store(spark, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the store that is written here."""
    path = fresh_path(spark, "store")
    write_store(load(spark, sf_dir, "documents"), path)
    if not verify_manifest(spark, path):
        raise ValueError("the manifest does not follow from the recipes")
    return document_sums(spark, path)
