"""Chat formatting (operator 9): token-level assembly.

A conversation is for each turn, in order: TURN, the role, SAY, the text, END.
The three marks are reserved ids behind the tokenizer's own; roles and texts
are encoded apart from each other (a byte-level vocabulary, so decoding is
exact) and the reserved ids are put between the encoded segments. The loss
mask has ones on the tokens of assistants' texts; it is the running sum of +1
where such a text begins and -1 where it ends.

Control strings in roles and texts (the marks' spellings and those of other
templates) are escaped, so that no text can pass for a mark in the formatted
string either: ESCAPE 1 comes behind the first character of each control
string, and an ESCAPE that was there becomes ESCAPE 0. unescape undoes it.

The output is one row for a part of a conversation, of at most PART_TOKENS
tokens but one turn at least: conv_id, turn, role, tie (those of the part's
first turn, which put parts in order), ids, mask. Turns are encoded where they
are, and dealt by ranges of conversation and place in it: a conversation that
holds a third of all turns is parts in many tasks, which no task holds whole.

Reading back decodes the parts where they are. What is left for one task a
conversation are its digests: SHA-256 takes a conversation's bytes one after
the other, so decoded parts stream through in order, one at a time.

Edge cases: null texts and roles are empty. Turns with equal numbers come in
the order of role and the digest of the text, null turns first. Rows whose
conv_id is null are one conversation; repeated rows are turns of their own. An
empty table gives an empty output. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import bounded_batches
from stratagrid.session import fresh_path, load

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
#: Strings that templates give a meaning to. Fixed values.
CONTROLS = [
    TURN, SAY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>",
    "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>",
]
ESCAPE = "␛"
PART_TOKENS = 1 << 16
LEARNED_ROLE = "assistant"

_BEGINS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    return _BEGINS.sub(lambda m: f"{m[0]}{ESCAPE}1", text.replace(ESCAPE, f"{ESCAPE}0"))


def unescape(text: str) -> str:
    return text.replace(f"{ESCAPE}1", "").replace(f"{ESCAPE}0", ESCAPE)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """A byte-level tokenizer and the reserved ids behind it."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 2
        self.turn, self.say, self.end = first, first + 1, first + 2
        self.mark = {self.turn: TURN, self.say: SAY, self.end: END}

    def encode(self, text: str | None) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(escape(text or "")), np.int32)

    def assemble(self, turns: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of turns: role, the role's ids, the text's ids."""
        pieces, steps, at = [], [], 0
        for role, name, text in turns:
            pieces += [[self.turn], name, [self.say], text, [self.end]]
            if role == LEARNED_ROLE:
                begin = at + len(name) + 2
                steps += [(begin, 1), (begin + len(text), -1)]
            at += len(name) + len(text) + 3
        ids = np.concatenate([np.asarray(p, np.int32) for p in pieces])
        change = np.zeros(len(ids) + 1, np.int32)
        for place, step in steps:
            change[place] += step
        return ids, np.cumsum(change)[:-1].astype(np.int8)

    def text_of(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode()

    def turns_of(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, str]]:
        """Role, text, text under the mask, and the formatted string of each turn."""
        ends = np.flatnonzero(ids == self.end)
        begin = 0
        for end in ends.tolist():
            own, learned = ids[begin:end], mask[begin:end]
            say = int(np.flatnonzero(own == self.say)[0])
            role, text = self.text_of(own[1:say]), self.text_of(own[say + 1 :])
            yield unescape(role), unescape(text), unescape(self.text_of(own[learned == 1])), f"{TURN}{role}{SAY}{text}{END}"
            begin = end + 1


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode_columns(path: str):
    @F.arrow_udf("array<int>")
    def of(column: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([own.encode(t) for t in column.to_pylist()], pa.list_(pa.int32()))

    return of


_PARTS = "conv_id long, turn long, role string, tie string, ids array<int>, mask array<tinyint>"
_PART_TYPES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("tie", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8()))])
_PLACE = ("conv_id", "turn", "role", "tie")


def _make_parts(path: str):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, tokens, place, out = codec(path), [], 0, None, []

        def flush():
            nonlocal held, tokens
            out.append((*place, *own.assemble(held)))
            held, tokens = [], 0

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PART_TYPES, strict=True)], schema=_PART_TYPES)

        for batch in batches:
            for conv, turn, role, tie, name, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if held and (conv != place[0] or tokens + len(text) > PART_TOKENS):
                    flush()
                if not held:
                    place = (conv, turn, role, tie)
                held.append((role, np.array(name, np.int32), np.array(text, np.int32)))
                tokens += len(text) + len(name) + 3
            if out:
                yield batch_of()
                out = []
        if held:
            flush()
        if out:
            yield batch_of()

    return parts


def format_conversations(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Columns conv_id, turn, role, tie, ids, mask, of rows conv_id, turn, role, text."""
    bounded_batches(rows.sparkSession, rows=2000, megabytes=16)
    path = path or ranks_path()
    encode = _encode_columns(path)
    ready = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    encoded = ready.select("conv_id", "turn", "role", F.sha2("text", 256).alias("tie"), encode("role").alias("name"), encode("text").alias("ids"))
    dealt = encoded.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
    return dealt.mapInArrow(_make_parts(path), _PARTS)


_DECODED = "conv_id long, turn long, role string, tie string, n int, turns binary, learned binary, learned_chars long, formatted_chars long"
_DECODED_TYPES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("tie", pa.string()), ("n", pa.int32()), ("turns", pa.binary()), ("learned", pa.binary()), ("learned_chars", pa.int64()), ("formatted_chars", pa.int64())])


def _decode_parts(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            rows = []
            for *place, ids, mask in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                turns = list(own.turns_of(np.array(ids, np.int32), np.array(mask, np.int8)))
                whole, learned = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns), "".join(x for _, _, x, _ in turns)
                rows.append((*place, len(turns), whole.encode(), learned.encode(), len(learned), sum(len(x) for *_, x in turns)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DECODED_TYPES, strict=True)], schema=_DECODED_TYPES)

    return decode


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of sorted, decoded parts."""
    conv, state, out = None, None, []

    def close():
        n, turns, chars, loss, formatted = state
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    for batch in batches:
        for name, n, turns, learned, learned_chars, formatted in zip(*(batch.column(k).to_pylist() for k in (0, 4, 5, 6, 7, 8)), strict=True):
            if state is not None and name != conv:
                close()
                state = None
            if state is None:
                conv, state = name, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += n
            state[1].update(turns)
            state[2] += learned_chars
            state[3].update(learned)
            state[4] += formatted
    if state is not None:
        close()
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(parts: DataFrame, path: str | None = None) -> DataFrame:
    """What the parts of each conversation say, decoded and unescaped."""
    bounded_batches(parts.sparkSession, rows=2000, megabytes=16)
    decoded = parts.select(*_PLACE, "ids", "mask").mapInArrow(_decode_parts(path or ranks_path()), _DECODED)
    return decoded.repartition("conv_id").sortWithinPartitions(*_PLACE).mapInArrow(_digest_parts, _READ)


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted, written and read back."""
    own = "</s>[INST] ok [/INST]"
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    path = fresh_path(spark, "chat")
    format_conversations(rows.unionByName(extra)).write.option("compression", "zstd").parquet(path)
    return read_back(spark.read.parquet(path))
