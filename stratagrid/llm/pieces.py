"""SentencePiece encoding and decoding (operator 7) by vectorised merge rounds.

The model's pieces and scores are read through the sentencepiece library; the
merging is done here. A text with its dummy prefix falls into segments, a run
of blanks and the word after it, which no piece of the model crosses (checked
when the model is read). The distinct segments of a slice of texts are laid
out as one flat array of symbols and merged in rounds: the segmented minimum
of the pair ranks is found for every segment at once, the leftmost pair of
that rank is merged in all segments, and finished segments leave the arrays.
The same pair further right in a segment is merged in the same round where
none of the pairs that this makes ranks as high as the pair itself, which is
when the one-by-one order would take it next anyway.

Characters without a piece fall back to their UTF-8 bytes. Decoding joins the
bytes of the pieces and takes the dummy prefix off.

Edge cases: null and empty texts have no ids and decode to the empty text.
The blank mark U+2581 in a text is a blank, as in the library. Texts without
blanks are one segment; its memory is in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import by_slices, texts

MARK = "▁"
NEVER = np.int64(1) << 30
ENCODED = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
_ENCODED = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Pieces:
    """The tables of a model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = {}
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[piece] = i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in plain):
            raise ValueError("a piece crosses the end of a word, so words can't be merged apart")
        self.text_of = [str(i) for i in range(n)]
        levels = np.unique([-model.get_score(i) for i in plain.values()])
        rank = {i: int(np.searchsorted(levels, -model.get_score(i))) for i in plain.values()}
        # A character that only longer pieces hold gets a number behind the pieces.
        chars = sorted({c for p in plain for c in p} - plain.keys())
        symbol = plain | {c: n + k for k, c in enumerate(chars)}
        self.first_spare, self.spare = n, chars
        self.of_char = np.full(0x110000, -1, np.int64)
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        self.width = n + len(chars)
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                if (a := symbol.get(p[:k])) is not None and (b := symbol.get(p[k:])) is not None:
                    pairs[a * self.width + b] = (rank[i], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NEVER], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; NEVER where the model has no such piece."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), at, len(self.keys))
        return self.ranks[at], self.merged[at]

    def merge(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their count for each segment of code points.

        A symbol below zero is -1 minus a code point that has no piece.
        """
        n = len(starts)
        sizes = np.diff(np.r_[starts, len(points)])
        symbols = self.of_char[points]
        symbols = np.where(symbols < 0, -1 - points, symbols)
        segment = np.repeat(np.arange(n), sizes)
        done_symbols, done_segments = [], []
        rank, piece = self._ranks(symbols, segment)
        while len(symbols):
            heads = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            # Rank and place in one number: the minimum is the leftmost pair of the best rank.
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), heads)
            live = (best >> 32) < NEVER
            if not live.all():
                lengths = np.diff(np.r_[heads, len(symbols)])
                stay = np.repeat(live, lengths)
                done_symbols.append(symbols[~stay])
                done_segments.append(segment[~stay])
                place = np.cumsum(stay) - 1
                symbols, segment, rank, piece = symbols[stay], segment[stay], rank[stay], piece[stay]
                at = place[(best[live] & 0xFFFFFFFF)]
                heads = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(symbols) else heads[:0]
            else:
                at = best & 0xFFFFFFFF
            if not len(symbols):
                break
            at = self._also(symbols, segment, rank, piece, heads, at)
            symbols[at] = piece[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, segment, rank, piece = symbols[keep], segment[keep], rank[keep], piece[keep]
            self._refresh(symbols, segment, rank, piece, place[at])
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        segment = np.concatenate(done_segments) if done_segments else np.zeros(0, np.int64)
        order = np.argsort(segment, kind="stable")
        return symbols[order], np.bincount(segment, minlength=n)

    def _ranks(self, symbols, segment) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(symbols), NEVER, np.int64)
        piece = np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(segment[1:] == segment[:-1])
        rank[inner], piece[inner] = self.look_up(symbols[inner], symbols[inner + 1])
        return rank, piece

    def _refresh(self, symbols, segment, rank, piece, at) -> None:
        """The pairs next to symbols that have just been merged."""
        around = np.unique(np.r_[at, at[at > 0] - 1])
        last = around + 1 >= len(symbols)
        rank[around[last]] = NEVER
        around = around[~last]
        inside = segment[around] == segment[around + 1]
        rank[around[~inside]] = NEVER
        around = around[inside]
        rank[around], piece[around] = self.look_up(symbols[around], symbols[around + 1])

    def _also(self, symbols, segment, rank, piece, heads, at) -> np.ndarray:
        """at and the places of the same pair that can be merged in the same round."""
        number = np.cumsum(np.r_[True, segment[1:] != segment[:-1]]) - 1
        top = at[number]
        same = (rank == rank[top]) & (piece == piece[top]) & (symbols == symbols[top]) & (rank < NEVER)
        if int(same.sum()) == len(at):
            return at
        places = np.flatnonzero(same)
        # In a chain of overlapping places (aaaa) every second one counts.
        fresh = np.r_[True, (np.diff(places) > 1) | (number[places[1:]] != number[places[:-1]])]
        chain = places[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        places = places[(places - chain) % 2 == 0]
        made, r = piece[places], rank[places]
        before, after = places - 1, places + 2
        has_before = (before >= 0) & (number[np.maximum(before, 0)] == number[places])
        has_after = (after < len(symbols)) & (number[np.minimum(after, len(symbols) - 1)] == number[places])
        safe = np.ones(len(places), bool)
        k = np.flatnonzero(has_before)
        safe[k] &= self.look_up(symbols[before[k]], made[k])[0] > r[k]
        k = np.flatnonzero(has_after)
        safe[k] &= self.look_up(made[k], symbols[after[k]])[0] > r[k]
        safe &= self.look_up(made, made)[0] > r
        # Up to and with the first unsafe place of each segment.
        owner = number[places]
        unsafe = np.cumsum(~safe) - (~safe)
        first = np.r_[True, owner[1:] != owner[:-1]]
        base = unsafe[np.flatnonzero(first)][np.cumsum(first) - 1]
        return places[unsafe == base]

    def ids_of(self, symbols: list[int]) -> list[int]:
        """Ids, with bytes for symbols that are no piece."""
        out = []
        for s in symbols:
            if 0 <= s < self.first_spare:
                out.append(s)
            else:
                char = chr(-1 - s) if s < 0 else self.spare[s - self.first_spare]
                out += self.byte_id[list(char.encode())].tolist()
        return out

    def segments(self, found: list[str]) -> list[list[int]]:
        """Ids of each segment, given with blanks as blanks."""
        if not found:
            return []
        joined = "".join(found).replace(" ", MARK)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        symbols, counts = self.merge(points, np.cumsum(sizes) - sizes)
        odd = (symbols < 0) | (symbols >= self.first_spare)
        flat, ends = symbols.tolist(), np.cumsum(counts)
        rows = [flat[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right")).tolist():
            rows[k] = self.ids_of(rows[k])
        return rows

    def encode(self, column: pa.Array) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Ids of the distinct segments, the segment at each place, and the places of each text."""
        distinct, places, counts = segmented(column)
        return self.segments(distinct), places, counts

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the dummy prefix."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def segmented(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct segments, the segment at each place, and the number of places of each text."""
    column = pc.replace_substring(pc.fill_null(column.cast(pa.string()), ""), MARK, " ")
    # Between single blanks a split is enough; other texts are cut by a pattern.
    simple = pc.invert(pc.match_substring_regex(column, "^ |  | $")).to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(column, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    distinct = [" " + w for w in coded.dictionary.to_pylist()]
    places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if simple.all() and not empty.any():
        return distinct, places, counts
    index = {w: k for k, w in enumerate(distinct)}
    parts, ends = [], np.cumsum(counts)
    for k in np.flatnonzero(~simple | empty).tolist():
        found = [] if empty[k] else re.findall(" +[^ ]*", " " + column[k].as_py())
        parts.append((k, np.array([index.setdefault(s, len(index)) for s in found], np.int64)))
    out, at = [], 0
    for k, own in parts:
        out += [places[at : ends[k] - counts[k]], own]
        at = ends[k]
    for k, own in parts:
        counts[k] = len(own)
    return list(index), np.concatenate([*out, places[at:]]), counts


def digests(model: Pieces, column: pa.Array) -> pa.Array:
    """Of each text the number of ids, and the digests of ids and of the decoded text."""
    ids, places, counts = model.encode(column)
    text = [",".join(map(model.text_of.__getitem__, x)) for x in ids]
    plain = [b"".join(map(model.bytes_of.__getitem__, x)) for x in ids]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))[places] if len(places) else places
    totals = np.r_[0, np.cumsum(sizes)]
    flat, ends = places.tolist(), np.cumsum(counts)
    n_tokens, id_digests, text_digests = [], [], []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        own = flat[a:b]
        n_tokens.append(int(totals[b] - totals[a]))
        id_digests.append(hashlib.sha256(",".join(map(text.__getitem__, own)).encode()).hexdigest())
        decoded = b"".join(map(plain.__getitem__, own)).removeprefix(b" ")
        text_digests.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
    return pa.StructArray.from_arrays([pa.array(n_tokens, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())], fields=list(_ENCODED))


def digest_column(path: str):
    """A column function from text to the struct of digests."""

    @F.arrow_udf(ENCODED)
    def of(column: pa.Array) -> pa.Array:
        return by_slices(lambda part: digests(pieces(path), part))(column)

    return of


def encode_column(path: str):
    """A column function from text to its array of ids."""

    def work(column: pa.Array) -> pa.Array:
        ids, places, counts = pieces(path).encode(column)
        ends = np.cumsum(counts)
        flat = places.tolist()
        rows = [[i for k in flat[a:b] for i in ids[k]] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        return pa.array(rows, pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def of(column: pa.Array) -> pa.Array:
        return by_slices(work)(column)

    return of


def decode_column(path: str):
    """A column function from an array of ids to the text; null ids give the empty text."""

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        model = pieces(path)
        return pa.array([model.decode(x or []) for x in column.to_pylist()], pa.string())

    return of


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256, decoded_sha256."""
    found = texts(docs, id_col, text_col).select("doc_id", digest_column(path)("text").alias("r"))
    return found.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    from stratagrid.session import load

    return encoded_digests(load(spark, sf_dir, "documents"), model_path())
