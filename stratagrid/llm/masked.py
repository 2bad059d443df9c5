"""Language-model scoring (operator 6): masked pseudo-likelihood.

A token is a word. Its probability given the words on both sides is that of
its class times that of the word within the class. Frequent words are classes
of their own, all others share classes by a hash of their last letters; within
a shared class a word's probability is its part of the class's occurrences in
the whole corpus, so a rare word scores below a usual one, and the
probabilities of all words of the corpus add up to one in every context.

The class comes from a bidirectional window network in numpy: the classes of
WINDOW words on each side have an embedding for each place, which add up in a
hidden layer (tanh), and a softmax over classes follows. A text's score is the
sum of the log-probabilities of all its tokens.

All of it is learned from all documents, at any size. Words are counted by
one aggregation, whose table grows with the corpus and stays one. The network
is trained in ROUNDS rounds, each over the documents of one hash slice, so
every document trains once: a task runs minibatch descent over its own
documents from the round's common weights, and the tasks' weights are
averaged by the tokens that they saw, in two levels, so the driver gets a few
sums only. Each task starts and orders its work from its data alone, so a
task that is run again gives the same weights.

For scoring, the most frequent words' probabilities are broadcast, HELD_WORDS
at most. Rarer words of a text are joined to the table of counts and
added up by text; as the frequent ones are gone, no word is a hot key. These
sums are of whole numbers (2**-32 units), so results don't depend on order.

Edge cases: null and wordless texts have no tokens, log-probability 0 and a
null mean. Without any word in the corpus nothing is trained and all scores
are 0. Repeated rows count and score one by one; equal texts score the same.
Intermediate tables are in the shared folder of the session.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import LOWER, as_bytes, row_slices, texts
from stratagrid.session import fresh_path, shared_folder

CLASSES = 96
#: Classes that less frequent words share by a hash of their last letters.
SHARED = 32
#: The class around a text.
EDGE = 0
#: Words on each side that a prediction sees.
WINDOW = 4
HIDDEN = 24
ROUNDS = 2
BATCH = 4096
RATE = 0.01
#: Words whose probabilities are broadcast; all others are joined.
HELD_WORDS = 1 << 16
#: Words that a task counts before it hands them on.
COUNTED_WORDS = 150_000
#: Tokens that the network scores at once.
SCORED_AT_ONCE = 1 << 15
SLICE = 4 << 20
#: Log-probabilities are added up in units of 1 / UNIT.
UNIT = float(1 << 32)
PARTS = ("window", "out", "bias")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


#: A-Z to a-z, ASCII white space to a blank.
_PLAIN = bytes(32 if b in b"\t\n\x0b\x0c\r " else LOWER[b] for b in range(256))


def coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts as numbers, how many each text has, and what the numbers stand for."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    data = data.to_pybytes()[at[0] : at[-1]].translate(_PLAIN) if data is not None else b""
    plain = pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(data)])
    lists = pc.split_pattern(plain, b" ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    found = lists.flatten().dictionary_encode()
    words = found.dictionary.to_pylist()
    code = found.indices.to_numpy(zero_copy_only=False)
    # Blanks next to each other leave empty words.
    real = code != words.index(b"") if b"" in words else np.ones(len(code), bool)
    ends = np.cumsum(counts)
    total = np.r_[0, np.cumsum(real)]
    return code[real], total[ends] - total[ends - counts], words


def shared_class(word: bytes) -> int:
    return CLASSES - SHARED + zlib.crc32(word[-3:]) % SHARED


@dataclass
class Laid:
    """Texts side by side: class numbers with WINDOW edges around each text, where its tokens are, and what they are."""

    numbers: np.ndarray
    places: np.ndarray
    #: Tokens of each text.
    sizes: np.ndarray
    #: The different words, and which of them each token is.
    words: list[bytes]
    code: np.ndarray


class Held:
    """The classes of words and the log-probabilities within classes of the most frequent ones."""

    def __init__(self, own_class: list[bytes], logs: dict[bytes, float]):
        self.number = {w: k + 1 for k, w in enumerate(own_class)}
        self.logs = logs

    def class_of(self, word: bytes) -> int:
        got = self.number.get(word)
        return shared_class(word) if got is None else got

    def laid_out(self, column: pa.Array) -> Laid:
        code, sizes, words = coded(column)
        classes = np.fromiter(map(self.class_of, words), np.int16, len(words))
        gaps = WINDOW * np.arange(1, len(sizes) + 1)
        places = np.arange(len(code)) + np.repeat(gaps, sizes)
        numbers = np.zeros(len(code) + WINDOW * (len(sizes) + 1), np.int16)
        numbers[places] = classes[code]
        return Laid(numbers, places, sizes, words, code)


# The network.


def fresh_weights(own: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights to begin with; own: occurrences of each class, which the bias takes in."""
    rng = np.random.default_rng(seed)
    share = own + 0.5
    w = {
        "window": rng.normal(0, 0.2, (2 * WINDOW * CLASSES, HIDDEN)),
        "out": rng.normal(0, 0.05, (HIDDEN, CLASSES)),
        "bias": np.log(share / share.sum()),
    }
    return {k: x.astype(np.float32) for k, x in w.items()}


def contexts(numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows of the embeddings that the prediction at each place adds up."""
    sides = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
    return np.stack([numbers[places + d].astype(np.int32) + k * CLASSES for k, d in enumerate(sides)], axis=1)


def _hidden(w: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    total = w["window"][rows[:, 0]]
    for k in range(1, rows.shape[1]):
        total += w["window"][rows[:, k]]
    return np.tanh(total)


def _logits(w: dict[str, np.ndarray], hidden: np.ndarray) -> np.ndarray:
    """Logits of the classes, moved so that their exponentials are finite."""
    out = hidden @ w["out"]
    out += w["bias"]
    # The hidden layer is between -1 and 1, so weights bound logits; trained ones hardly ever need to be moved.
    if float(np.abs(w["out"]).sum(axis=0).max() + np.abs(w["bias"]).max()) > 60:
        out -= out.max(axis=1, keepdims=True)
    return out


def loss_and_gradient(w: dict[str, np.ndarray], rows: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean negative log-probability of the classes and its slope in all weights."""
    n, every = len(truth), np.arange(len(truth))
    hidden = _hidden(w, rows)
    slope = _logits(w, hidden)
    own = slope[every, truth].copy()
    np.exp(slope, out=slope)
    total = slope.sum(axis=1)
    loss = float((np.log(total) - own).mean())
    # From here on slope is what it is called: probabilities less the truth, over the number of tokens.
    slope /= total[:, None] * n
    slope[every, truth] -= 1 / n
    back = np.ascontiguousarray(((slope @ w["out"].T) * (1 - hidden * hidden)).T, dtype=np.float64)
    window = np.empty((rows.shape[1], CLASSES, len(back)), hidden.dtype)
    for side in range(rows.shape[1]):
        classes = rows[:, side] - side * CLASSES
        for k, x in enumerate(back):
            window[side, :, k] = np.bincount(classes, x, CLASSES)
    return loss, {"window": window.reshape(-1, len(back)), "out": hidden.T @ slope, "bias": slope.sum(axis=0)}


class Descent:
    """Adam over minibatches; weights are those of the caller, changed in place."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w, self.step, self.tokens = weights, 0, 0
        self.first = {k: np.zeros_like(x) for k, x in weights.items()}
        self.second = {k: np.zeros_like(x) for k, x in weights.items()}

    def learn(self, numbers: np.ndarray, places: np.ndarray) -> None:
        for a in range(0, len(places), BATCH):
            part = places[a : a + BATCH]
            _, g = loss_and_gradient(self.w, contexts(numbers, part), numbers[part].astype(np.int64))
            self.step += 1
            self.tokens += len(part)
            for k in PARTS:
                self.first[k] += 0.1 * (g[k] - self.first[k])
                self.second[k] += 0.01 * (g[k] * g[k] - self.second[k])
                self.w[k] -= RATE * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.99**self.step)) + 1e-8)


def class_logs(w: dict[str, np.ndarray], numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The log-probability of the class at each place."""
    out = np.zeros(len(places))
    for a in range(0, len(places), SCORED_AT_ONCE):
        part = places[a : a + SCORED_AT_ONCE]
        x = _logits(w, _hidden(w, contexts(numbers, part)))
        own = x[np.arange(len(part)), numbers[part]].astype(np.float64)
        out[a : a + len(part)] = own - np.log(np.exp(x, out=x).sum(axis=1))
    return out


# The jobs.


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in as_bytes(batch.column(0)):
            counts.update(words_of(text))
            if len(counts) > COUNTED_WORDS:
                yield out()
                counts = Counter()
    yield out()


@lru_cache(3)
def _loaded(blob: bytes):
    return pickle.loads(blob)


def word_table(docs: DataFrame) -> DataFrame:
    """Columns word, n: the occurrences of every word of the corpus, a written table."""
    shared_folder(docs.sparkSession)
    return docs.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).checkpoint()


def held_words(counts: DataFrame) -> tuple[Held, np.ndarray, int]:
    """What tasks hold of the words, the occurrences of each class, and the count up to which words are joined."""
    # A few thousand steps of counts say from which count on words are few enough to be held.
    step = F.floor(F.log2("n") * 64).cast("int")
    cut, total = None, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r["s"]):
        total += r["words"]
        if total > HELD_WORDS:
            break
        cut = r["least"]
    top = counts.where(F.col("n") >= cut).collect() if cut is not None else []
    words = sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda x: (-x[1], x[0]))
    own = [w for w, _ in words[: CLASSES - SHARED - 1]]
    tail = F.when(F.length("word") > 3, F.substring("word", -3, 3)).otherwise(F.col("word"))
    totals = {r["c"]: r["n"] for r in counts.groupBy((F.crc32(tail) % SHARED).alias("c")).agg(F.sum("n").alias("n")).collect()}
    size = np.zeros(CLASSES, np.int64)
    for c, n in totals.items():
        size[CLASSES - SHARED + c] = n
    for k, (w, n) in enumerate(words[: len(own)]):
        size[k + 1] = n
        size[shared_class(w)] -= n
    frequent = dict.fromkeys(own, 0.0) | {w: float(np.log(n / size[shared_class(w)])) for w, n in words[len(own) :]}
    return Held(own, frequent), size, cut - 1 if cut is not None else 1 << 62


def _train_round(docs: DataFrame, held, weights: dict[str, np.ndarray], part: int, rounds: int) -> dict[str, np.ndarray]:
    """The average of the weights that each task gets to from its own documents of the part."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(weights))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Descent({k: x.copy() for k, x in _loaded(shared.value).items()})
        for batch in batches:
            for a, b in row_slices(batch.column(0), SLICE):
                laid = _loaded(held.value).laid_out(batch.column(0).slice(a, b - a))
                # Neighbouring tokens are alike, so minibatches are drawn from the whole slice.
                own.learn(laid.numbers, np.random.default_rng(len(laid.places)).permutation(laid.places))
        yield _weight_row(own.tokens, own.w)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, None
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = np.frombuffer(blob) * n
                total = flat if total is None else total + flat
                tokens += n
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([(total / tokens).tobytes()], pa.binary())], ["tokens", "weights"])

    rows = docs.where(F.pmod(F.xxhash64("text", F.lit("round")), F.lit(rounds)) == part).select("text")
    schema = "tokens long, weights binary"
    learned = rows.mapInArrow(learn, schema).where("tokens > 0")
    # Tasks' weights are added up in a few groups first, so the driver gets a few sums.
    groups = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    sums = learned.repartition(groups).mapInArrow(add, schema).collect()
    tokens = sum(r["tokens"] for r in sums)
    if not tokens:
        return weights
    flat = sum(np.frombuffer(bytes(r["weights"])) * r["tokens"] for r in sums) / tokens
    return _unflattened(flat)


def _weight_row(tokens: int, w: dict[str, np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate([w[k].ravel() for k in PARTS]).astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["tokens", "weights"])


def _unflattened(flat: np.ndarray) -> dict[str, np.ndarray]:
    shapes = {"window": (2 * WINDOW * CLASSES, HIDDEN), "out": (HIDDEN, CLASSES), "bias": (CLASSES,)}
    out, at = {}, 0
    for k in PARTS:
        size = int(np.prod(shapes[k]))
        out[k] = flat[at : at + size].reshape(shapes[k]).astype(np.float32)
        at += size
    return out


def score_texts(column: pa.Array, held: Held, weights: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Tokens of each text, the sum of what is known here in units of 1 / UNIT, and the words that are joined."""
    laid = held.laid_out(column)
    inner = np.fromiter((held.logs.get(w, np.nan) for w in laid.words), np.float64, len(laid.words))[laid.code]
    rare = np.isnan(inner)
    each = class_logs(weights, laid.numbers, laid.places) + np.where(rare, 0.0, inner)
    ends = np.cumsum(laid.sizes)
    running = np.r_[0, np.cumsum(np.rint(each * UNIT).astype(np.int64))]
    before = np.r_[0, np.cumsum(rare)]
    words = pa.array(laid.words, pa.binary()).take(pa.array(laid.code[rare]))
    return laid.sizes, running[ends] - running[ends - laid.sizes], pa.ListArray.from_arrays(pa.array(np.r_[0, before[ends]].astype(np.int32)), words)


_SCORED = "struct<n_tokens: bigint, known: bigint, rare: array<binary>>"


def _scores(docs: DataFrame, held, weights: dict[str, np.ndarray]) -> DataFrame:
    """Columns doc_id, a, b (hashes of the text), n_tokens, known, rare."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(weights))

    @F.arrow_udf(_SCORED)
    def of(column: pa.Array) -> pa.Array:
        own, w = _loaded(held.value), _loaded(shared.value)
        parts = [score_texts(column.slice(a, b - a), own, w) for a, b in row_slices(column, SLICE)]
        n = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        known = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        rare = pa.concat_arrays([p[2] for p in parts]) if parts else pa.array([], pa.list_(pa.binary()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(known, pa.int64()), rare], names=["n_tokens", "known", "rare"])

    found = docs.select("doc_id", F.xxhash64("text", F.lit("a")).alias("a"), F.xxhash64("text", F.lit("b")).alias("b"), of("text").alias("r"))
    return found.select("doc_id", "a", "b", "r.n_tokens", "r.known", "r.rare")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Columns doc_id, n_tokens, log_prob, mean_log_prob."""
    spark = docs.sparkSession
    own = texts(docs, id_col, text_col)
    counts = word_table(own)
    if counts.isEmpty():
        return own.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_prob"), F.lit(None).cast("double").alias("mean_log_prob"))
    words, size, joined_up_to = held_words(counts)
    held = spark.sparkContext.broadcast(pickle.dumps(words))
    weights = fresh_weights(size)
    for part in range(rounds):
        weights = _train_round(own, held, weights, part, rounds)
    path = fresh_path(spark, "masked")
    _scores(own, held, weights).write.option("compression", "zstd").parquet(path)
    scored = spark.read.parquet(path)
    # The probability of each word that tasks don't hold, within its class.
    tail = F.when(F.length("word") > 3, F.substring("word", -3, 3)).otherwise(F.col("word"))
    class_size = F.array(*[F.lit(float(max(1, n))) for n in size[CLASSES - SHARED :].tolist()])
    logs = F.round(F.log(F.col("n") / F.get(class_size, (F.crc32(tail) % SHARED).cast("int"))) * UNIT).cast("long")
    rest = counts.where(F.col("n") <= joined_up_to).select("word", logs.alias("log"))
    rare = scored.where(F.size("rare") > 0).select("a", "b", F.explode("rare").alias("word"))
    # Equal texts come together here, each with the same sum.
    copies = scored.where(F.size("rare") > 0).groupBy("a", "b").agg(F.count("*").alias("copies"))
    sums = rare.join(rest, "word").groupBy("a", "b").agg(F.sum("log").alias("log")).join(copies, ["a", "b"]).select("a", "b", F.expr("log div copies").alias("log"))
    found = scored.select("doc_id", "a", "b", "n_tokens", "known").join(sums, ["a", "b"], "left")
    total = (F.col("known") + F.coalesce("log", F.lit(0))) / UNIT
    return found.select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))


def op6_masked_lm(spark, sf_dir: str) -> DataFrame:
    """Every document's pseudo-likelihood."""
    from stratagrid.session import load

    return pseudo_likelihood(load(spark, sf_dir, "documents"))
