"""Quality classifier (operator 8): weak labels and a hashed linear scorer.

Heuristic labellers look at each document. There are five ways to be bad
(KINDS), and three overlapping labellers for each, which measure different
things; each votes bad or not. How often each combination of votes occurs is
counted over all documents. For each kind, expectation-maximisation on these
counts estimates without any truth how large the bad class is and, for each
labeller, how often it votes on bad and on good documents, which is its
accuracy; that gives each document a posterior of being bad in that way. It is
bad if it is bad in any way. A linear scorer over hashed features is then
trained towards the posteriors on a bounded sample (SAMPLE_ROWS documents in
expectation, drawn evenly over which kinds have votes, by a hash of doc_id),
and every document's whole text is scored with it.

One kind looks for abusive words. These are learned from a table of labelled
documents: words that occur in LEAST_DOCUMENTS different documents labelled
toxic, and of the labelled documents with the word at least LEAST_SHARE are
toxic. Both classes are counted in the same unit, distinct sketches (the least
hash of a text's word triples), so copies count once and different documents
don't merge. About LABELLED_ROWS labelled documents are read for this, in
expectation. Without labels there are no such words and the kind has no votes.

Texts are measured twice: once for the votes, when the features of those that
may be in the sample are written beside them, once to be scored.

Edge cases: null and wordless texts have no votes and the score of the empty
text, 0, and are rejected. Without any bad document all others are kept. Rows
that repeat a doc_id are scored one by one; in the table of labels a doc_id
that is labelled toxic anywhere counts as toxic, null labels as none. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import as_bytes, row_slices, texts
from stratagrid.session import fresh_path

LABELLED_ROWS = 40_000
#: A word is abusive if it is in this many different toxic documents, and this share of its documents is toxic.
LEAST_DOCUMENTS, LEAST_SHARE = 5, 0.9
SAMPLE_ROWS = 12_000
FEATURE_BITS = 14
EPOCHS = 8
THRESHOLD = 0.5

KINDS = ("shouting", "symbols", "table", "repeated", "abusive")
#: For each kind the measures that its labellers look at, and above which value each votes bad.
LABELLERS = (
    (("upper_letters", 0.4), ("upper_words", 0.4), ("exclaimed", 0.15)),
    (("symbols", 0.08), ("symbol_runs", 0.04), ("symbol_bytes", 0.012)),
    (("bars", 0.15), ("bar_lines", 0.5), ("bar_bytes", 0.02)),
    (("neighbours", 0.25), ("top_word", 0.3), ("sameness", 0.28)),
    (("abusive", 0.5), ("abusive", 1.5), ("abusive_share", 0.01)),
)
MEASURES = tuple(dict.fromkeys(name for own in LABELLERS for name, _ in own))

_NO_WORD = re.compile(rb"[^A-Za-z0-9\x80-\xff]+")
_SYMBOLS = b"#$%&*!^~<>=_@\\{}"
_SYMBOL_RUN = re.compile(rb"[#$%&*^~<>=_@\\{}]{2,}")
_KEEP_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))
_UPPER_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_UPPER = bytes(set(range(256)) - set(_UPPER_BYTES))
_NO_LOWER = bytes(set(range(256)) - set(_UPPER_BYTES.lower()))


@dataclass
class Measures:
    """What the labellers and features look at in a text."""

    value: dict[str, float]
    vocabulary: set[bytes] = field(repr=False)


def lower_words(text: bytes) -> list[bytes]:
    """Letters and digits in a row, in lower case."""
    return _NO_WORD.sub(b" ", text.decode("utf-8", "replace").lower().encode()).split()


def measure(text: bytes | None, lexicon: frozenset[bytes]) -> Measures | None:
    """None for a text without words."""
    text = text or b""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return None
    upper, lower = len(text.translate(None, _NO_UPPER)), len(text.translate(None, _NO_LOWER))
    words = lower_words(text)
    own = set(words)
    named = own & lexicon
    symbols, bars, lines = len(text.translate(None, _KEEP_SYMBOLS)), text.count(b"|"), text.split(b"\n")
    different = len(set(tokens))
    # The most frequent word is looked for among those that could be it.
    long_enough = n >= 20
    top = max(map(tokens.count, set(tokens[:: max(1, n // 16)]))) / n if long_enough and different < 0.75 * n else 0.0
    return Measures(
        {
            "upper_letters": upper / max(1, upper + lower) if upper + lower >= 10 else 0.0,
            "upper_words": sum(map(bytes.isupper, tokens)) / n,
            "exclaimed": text.count(b"!!") / n,
            "symbols": symbols / n,
            "symbol_runs": len(_SYMBOL_RUN.findall(text)) / n if symbols else 0.0,
            "symbol_bytes": symbols / len(text),
            "bars": tokens.count(b"|") / n,
            "bar_lines": sum(x.count(b"|") >= 3 for x in lines) / len(lines) if bars else 0.0,
            "bar_bytes": bars / len(text),
            "neighbours": sum(map(bytes.__eq__, tokens, tokens[1:])) / n,
            "top_word": top,
            "sameness": 1 - float(np.log(different) / np.log(n)) if long_enough else 0.0,
            "abusive": float(len(named)),
            "abusive_share": sum(map(named.__contains__, words)) / n if named else 0.0,
        },
        own,
    )


def votes(m: Measures | None) -> int:
    """The labellers' votes as the bits of a number, three for each kind."""
    if m is None:
        return 0
    return sum(1 << (3 * k + j) for k, own in enumerate(LABELLERS) for j, (name, least) in enumerate(own) if m.value[name] > least)


def kinds_of(pattern: int) -> int:
    """Which kinds have a vote, as bits."""
    return sum(1 << k for k in range(len(KINDS)) if pattern >> 3 * k & 7)


@dataclass
class Accuracy:
    """What expectation-maximisation finds out about the labellers of one kind."""

    bad: float
    #: For each labeller how often it votes on bad and on good documents.
    hits: np.ndarray
    false_alarms: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """The share of documents on which each labeller is right."""
        return self.bad * self.hits + (1 - self.bad) * (1 - self.false_alarms)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The probability of bad for rows of votes (0 or 1)."""
        odds = np.log(self.bad) - np.log1p(-self.bad) + v @ (np.log(self.hits) - np.log(self.false_alarms)) + (1 - v) @ (np.log1p(-self.hits) - np.log1p(-self.false_alarms))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def estimate(v: np.ndarray, n: np.ndarray, rounds: int = 500) -> Accuracy:
    """Expectation-maximisation over different rows of votes and how often each occurs.

    Two classes, in which labellers vote independently of each other. It
    begins with the majority's view. What is known beforehand counts as a few
    documents: that labellers mostly find what they look for (8 of 10) and
    seldom vote on good documents (1 of 100).
    """
    bad = np.where(v.sum(axis=1) * 2 > v.shape[1], 0.95, np.where(v.any(axis=1), 0.3, 0.001))
    for _ in range(rounds):
        now = Accuracy(float(np.clip(n @ bad / n.sum(), 1e-9, 1 - 1e-9)), ((n * bad) @ v + 8) / (n @ bad + 10), ((n * (1 - bad)) @ v + 1) / (n @ (1 - bad) + 100))
        new = now.posterior(v)
        if np.abs(new - bad).max() < 1e-10:
            break
        bad = new
    return now


def accuracies(counts: dict[int, int]) -> list[Accuracy]:
    """For each kind what its labellers are worth, from the counts of all patterns of votes."""
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns.tolist()], float)
    out = []
    for k in range(len(KINDS)):
        own, at = np.unique(patterns >> 3 * k & 7, return_inverse=True)
        out.append(estimate((own[:, None] >> np.arange(3) & 1).astype(float), np.bincount(at, n)))
    return out


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """The probability that a document with a pattern of votes is bad in some way."""
    found = accuracies(counts)
    patterns = sorted(counts)
    good = np.ones(len(patterns))
    for k, own in enumerate(found):
        good *= 1 - own.posterior((np.array(patterns)[:, None] >> 3 * k >> np.arange(3) & 1).astype(float))
    return dict(zip(patterns, (1 - good).tolist(), strict=True))


def features(m: Measures | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values.

    Binned measures count fully; the presence of a word by the square root of
    the number of different words, so that long texts don't add up chance.
    """
    if m is None:
        return np.zeros(1, np.int64), np.ones(1)
    half = 1 << FEATURE_BITS - 1
    fixed = [zlib.crc32(f"{name}:{bin_of(m.value[name])}".encode()) % half for name in MEASURES]
    words = [zlib.crc32(w) % half + half for w in m.vocabulary]
    weight = 0.2 / np.sqrt(max(1, len(words)))
    return np.array(fixed + words, np.int64), np.r_[np.ones(len(fixed)), np.full(len(words), weight)]


_BINS = [0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.12, 0.15, 0.2, 0.25, 0.28, 0.33, 0.4, 0.5, 0.75, 1.5, 3.5]


def bin_of(x: float) -> int:
    return int(np.searchsorted(_BINS, x))


@dataclass
class Scorer:
    lexicon: frozenset[bytes]
    weights: np.ndarray
    bias: float

    def score(self, text: bytes | None) -> tuple[float, int]:
        """The probability of being good, and the votes."""
        m = measure(text, self.lexicon)
        if m is None:
            return 0.0, 0
        at, value = features(m)
        return float(1 / (1 + np.exp(np.clip(self.bias + self.weights[at] @ value, -40, 40)))), votes(m)


def train(rows: list[tuple[np.ndarray, np.ndarray, float, float]], lexicon: frozenset[bytes], seed: int = 3) -> Scorer:
    """Logistic regression towards posteriors of being bad; rows: features, values, posterior, weight."""
    rng = np.random.default_rng(seed)
    weights, squares, bias = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-2), 0.0
    for _ in range(EPOCHS if rows else 0):
        for k in rng.permutation(len(rows)).tolist():
            at, value, bad, weight = rows[k]
            p = 1 / (1 + np.exp(-np.clip(bias + weights[at] @ value, -40, 40)))
            slope = weight * (p - bad)
            step = slope * value + 1e-5 * weights[at]
            squares[at] += step * step
            weights[at] -= 0.3 * step / np.sqrt(squares[at])
            bias -= 0.02 * slope
    return Scorer(lexicon, weights, bias)


@lru_cache(2)
def _loaded(blob: bytes):
    return pickle.loads(blob)


def sketch(words: list[bytes]) -> int:
    """The least hash of a text's word triples: copies share it, different texts hardly ever."""
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    if len(codes) < 3:
        return int(zlib.crc32(b" ".join(words)))
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    return int((mixed >> np.uint64(2)).min())


def learned_words(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> list[bytes]:
    """Words that tell toxic documents, from labelled ones."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    total = marks.count()
    if total == 0:
        return []
    share = min(1.0, labelled_rows / total)
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(batch.column(0), 1 << 20):
                out, sketches, toxic = [], [], []
                for text, mark in zip(as_bytes(batch.column(0).slice(a, b - a)), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    every = lower_words(text or b"")
                    own = {w for w in set(every) if len(w) > 2}
                    if own:
                        out += own
                        sketches += [sketch(every)] * len(own)
                        toxic += [int(mark == 1)] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(sketches, pa.int64()), pa.array(toxic, pa.int32())], ["word", "sketch", "toxic"])

    # About LABELLED_ROWS marks, so texts stay where they are.
    rows = docs.join(F.broadcast(marks), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    found = rows.mapInArrow(words, "word binary, sketch long, toxic int")
    # One row a word and sketch first, so a frequent word is never one task's rows.
    counts = found.groupBy("word", "sketch").agg(F.max("toxic").alias("toxic")).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    kept = counts.where((F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("toxic") >= LEAST_SHARE * F.col("n")))
    return [bytes(r["word"]) for r in kept.select("word").orderBy("word").collect()]


_MEASURED = pa.schema([("v", pa.int32()), ("number", pa.float64()), ("at", pa.binary()), ("value", pa.binary())])


def _measured(docs: DataFrame, lexicon: frozenset[bytes], few: float) -> DataFrame:
    """Columns v (votes), number (even in 0 to 1), at and value (features) of texts.

    Features are there for texts with votes, and for those without whose number is below few.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(shared.value)
        for batch in batches:
            for a, b in row_slices(batch.column(0)):
                out = []
                for text, number in zip(as_bytes(batch.column(0).slice(a, b - a)), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    m = measure(text, own)
                    v = votes(m)
                    at, value = features(m) if v or number < few else (None, None)
                    out.append((v, number, None if at is None else at.astype(np.int16).tobytes(), None if at is None else value.astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MEASURED, strict=True)], schema=_MEASURED)

    number = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("scorer")), F.lit(1 << 20)) / float(1 << 20), F.lit(0.0))
    return docs.where("text is not null").select("text", number.alias("number")).mapInArrow(work, "v int, number double, at binary, value binary")


def fit(docs: DataFrame, labels: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """A scorer from the texts of docs (doc_id, text) and what is labelled toxic."""
    spark = docs.sparkSession
    lexicon = frozenset(learned_words(docs, labels) if labels is not None else [])
    few = min(1.0, 2 * sample_rows / max(1, docs.count()))
    path = fresh_path(spark, "quality")
    _measured(docs, lexicon, few).write.option("compression", "zstd").parquet(path)
    table = spark.read.parquet(path)
    counts = {r["v"]: r["count"] for r in table.groupBy("v").count().collect()}
    if not counts:
        return Scorer(lexicon, np.zeros(1 << FEATURE_BITS), 0.0)
    bad = posteriors(counts)
    # Evenly over combinations of kinds: each gets its part of the sample, or all its documents.
    size: dict[int, int] = {}
    for v, n in counts.items():
        size[kinds_of(v)] = size.get(kinds_of(v), 0) + n
    each = max(1, sample_rows // len(size))
    share = {k: min(1.0, each / n) if k else min(few, each / n) for k, n in size.items()}
    kinds = sum((F.when(F.col("v").bitwiseAND(7 << 3 * k) != 0, 1 << k).otherwise(0) for k in range(len(KINDS))), F.lit(0))
    least = F.create_map(*[x for k, s in sorted(share.items()) for x in (F.lit(k), F.lit(s))])
    drawn = table.where(F.col("number") < least[kinds]).where("at is not null").select("v", "at", "value").collect()
    rows = sorted((r["v"], bytes(r["at"]), bytes(r["value"])) for r in drawn)
    weight = {k: size[k] * share[k] for k in size}
    mean = sum(weight.values()) / len(weight)
    return train([(np.frombuffer(at, np.int16).astype(np.int64), np.frombuffer(x, np.float32).astype(float), bad[v], float(np.clip(mean / max(1.0, weight[kinds_of(v)]), 0.2, 5))) for v, at, x in rows], lexicon)


SCORED = "struct<score: double, votes: int>"
_SCORED = pa.struct([("score", pa.float64()), ("votes", pa.int32())])


def score_column(spark, scorer: Scorer):
    """A column function from text to the score (1 good, 0 bad) and the votes."""
    shared = spark.sparkContext.broadcast(pickle.dumps(scorer))

    @F.arrow_udf(SCORED)
    def of(column: pa.Array) -> pa.Array:
        own, out = _loaded(shared.value), []
        for a, b in row_slices(column):
            out += [own.score(t) for t in as_bytes(column.slice(a, b - a))]
        return pa.StructArray.from_arrays([pa.array([s for s, _ in out], pa.float64()), pa.array([v for _, v in out], pa.int32())], fields=list(_SCORED))

    return of


def quality(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, score, votes (the kinds that have one), keep."""
    own = texts(docs, id_col, text_col)
    scorer = fit(own, labels)
    found = own.select("doc_id", score_column(docs.sparkSession, scorer)("text").alias("r"))
    names = F.filter(F.array(*[F.when(F.col("r.votes").bitwiseAND(7 << 3 * k) != 0, name) for k, name in enumerate(KINDS)]), lambda x: x.isNotNull())
    return found.select("doc_id", "r.score", F.array_join(names, ",").alias("votes"), (F.col("r.score") >= THRESHOLD).alias("keep"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's score and whether it is kept."""
    from stratagrid.session import load

    return quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
