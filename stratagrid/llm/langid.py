"""Language identification (operator 10): averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed byte n-grams (words
with a blank before and after, folded to lower case), a linear layer and a
softmax turn that into probabilities. The model is trained in numpy by
stochastic gradient descent. Embedding and linear layer are both linear, so
for prediction they are folded into one table with a row of logits for each
bucket: a text's logits are the mean of its n-grams' rows.

The fit takes a bounded sample of labelled documents: PER_LANGUAGE of each
language in expectation, fewer where languages are so many that this would
be over TRAIN_ROWS, chosen by a hash of doc_id and reduced to hashed counts on
the executors, so no text goes to the driver. Of a text in the sample with
more than TRAIN_BUCKETS different buckets, that many are drawn evenly by a
hash, so the sample's bytes have a bound, too.

A fifth of the sample calibrates. It sets the temperature of the softmax, and
when a prediction is rejected. Each n-gram of a text speaks for the predicted
language by how far its logit is above the mean of all languages; a text in a
language that was learned has a mean of these that hardly varies, one in
another language a lower one. For each language the least mean is the one that
REJECT_SHARE of its calibration texts would not reach if the means were
normally distributed, with the spread that texts of few n-grams have: it
falls with the square root of their number.

Edge cases: texts that are null or hold no letter (Unicode category L) are
"und" with score 0 and rejected. Without labelled documents every text is
"und". With one language it is that language with score 1. Rows whose doc_id
or lang is null are no part of the fit but are predicted. Texts are read whole,
in slices, so memory does not grow with their length times the languages.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import as_bytes, row_slices, texts

BUCKET_BITS = 16
SIZES = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 6
PER_LANGUAGE = 600
#: Rows of the sample in all languages, and different buckets of a row.
TRAIN_ROWS = 40_000
TRAIN_BUCKETS = 4_096
REJECT_SHARE = 0.0001
#: What a text's lead may fall short besides, as a part of the usual one; texts in two languages have less.
SLACK = 0.2
#: Numbers that a worker holds at once while it adds up logits.
CELLS = 1 << 22
UNKNOWN = "und"
PREDICTED = "struct<lang_pred: string, score: double, accepted: boolean>"
_PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

#: Folding on bytes: A-Z to a-z, ASCII that is no letter to a blank, other characters' bytes kept.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def have_letters(texts_: list[bytes | None]) -> np.ndarray:
    """Which texts hold a character of category L."""
    return pc.fill_null(pc.match_substring_regex(pa.array(texts_, pa.binary()).cast(pa.string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)


def subwords(folded: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the first places and buckets of the n-grams that hold no inner blank."""
    blank = folded == 32
    code = folded.astype(np.uint32)
    mixed = code.copy()
    for size in range(2, max(SIZES) + 1):
        mixed = mixed[:-1] * np.uint32(0x01000193) ^ code[size - 1 :]
        if size in SIZES:
            inner = np.zeros(len(mixed), bool)
            for k in range(1, size - 1):
                inner |= blank[k : k + len(mixed)]
            if size == 2:
                inner = blank[: len(mixed)] & blank[1 : 1 + len(mixed)]
            places = np.flatnonzero(~inner)
            yield places, ((mixed[places] * np.uint32(0x9E3779B1) + np.uint32(size)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def _laid_out(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of texts with four blanks around each, and where each begins."""
    gap = b" " * max(SIZES)
    joined = gap + gap.join((t or b"").translate(FOLDED) for t in rows) + gap
    sizes = np.fromiter((len(t or b"") + len(gap) for t in rows), np.int64, len(rows))
    return np.frombuffer(joined, np.uint8), np.cumsum(sizes) - sizes


def counted(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs."""
    folded, _ = _laid_out([text])
    buckets = np.concatenate([b for _, b in subwords(folded)]) if len(folded) > max(SIZES) else np.zeros(0, np.int32)
    return np.unique(buckets, return_counts=True)


@dataclass
class Model:
    languages: list[str]
    #: Logits of each bucket, the temperature taken in.
    table: np.ndarray
    bias: np.ndarray
    #: The usual lead of a text's language, how far below it a text of one n-gram may be, and one of very many.
    centre: np.ndarray
    spread: np.ndarray
    slack: np.ndarray

    def sums(self, rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The sums of the n-grams' logits of each text, and their numbers."""
        folded, first = _laid_out(rows)
        total = np.zeros((len(rows), len(self.languages)))
        count = np.zeros(len(rows), np.int64)
        step = max(1024, CELLS // max(1, len(self.languages)))
        for places, buckets in subwords(folded):
            owner = np.searchsorted(first, places, "right") - 1
            for a in range(0, len(places), step):
                own, at = owner[a : a + step], buckets[a : a + step]
                heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[heads]] += np.add.reduceat(self.table[at], heads, axis=0, dtype=np.float64)
            count += np.bincount(owner[owner >= 0], minlength=len(rows))
        return total, count

    def predict(self, rows: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        known = have_letters(rows)
        if not self.languages:
            return [UNKNOWN] * len(rows), np.zeros(len(rows)), np.zeros(len(rows), bool)
        total, count = self.sums(rows)
        mean = total / np.maximum(count, 1)[:, None]
        p = _softmax(mean + self.bias)
        best, every = p.argmax(axis=1), np.arange(len(rows))
        score = np.where(known, np.clip(p[every, best], 0, 1), 0.0)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        lead = mean[every, best] - mean.mean(axis=1)
        return names, score, known & (lead >= self.centre[best] - self.spread[best] / np.sqrt(np.maximum(count, 1)) - self.slack[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(languages: list[str], rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Stochastic gradient descent over (language number, buckets, counts)."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist()) if len(rows) >= 20 else set()
    embedding = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weight, bias = np.zeros((DIMENSIONS, n), np.float32), np.zeros(n, np.float32)
    fit = [k for k in order.tolist() if k not in held]
    steps, done = max(1, EPOCHS * len(fit)), 0
    shares = [(c / max(1, c.sum())).astype(np.float32) for _, _, c in rows]
    for _ in range(EPOCHS):
        for k in rng.permutation(fit).tolist():
            language, buckets, _ = rows[k]
            if not len(buckets):
                continue
            rate = 1.5 * (1 - done / steps)
            done += 1
            hidden = shares[k] @ embedding[buckets]
            slope = _softmax((hidden @ weight + bias)[None])[0]
            slope[language] -= 1
            back = weight @ slope
            weight -= rate * np.outer(hidden, slope)
            bias -= 0.05 * rate * slope
            # Counts of a frequent n-gram shrink its step; the square root keeps rare ones in the model.
            embedding[buckets] -= (rate * np.sqrt(shares[k]))[:, None] * back
    table = embedding @ weight
    check = [k for k in sorted(held or range(len(rows))) if len(rows[k][1])]
    logits = np.array([shares[k] @ table[rows[k][1]] + bias for k in check]) if check else np.zeros((0, n))
    truth = np.array([rows[k][0] for k in check], np.int64)
    scale = _temperature(logits, truth)
    table = (table * scale).astype(np.float32)
    own = [_calibrated(table, [rows[i] for i in check if rows[i][0] == k], k) for k in range(n)]
    centre, spread, slack = (np.array(x, float) for x in zip(*own, strict=True)) if own else (np.zeros(0),) * 3
    return Model(languages, table, bias * scale, centre, spread, slack)


def _calibrated(table: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]], language: int) -> tuple[float, float, float]:
    """Mean lead of a language's texts, the tolerated shortfall of one n-gram, and that of a whole text."""
    if not rows or table.shape[1] < 2:
        return -np.inf, 0.0, 0.0
    from statistics import NormalDist

    far = -NormalDist().inv_cdf(REJECT_SHARE)
    leads, within = [], []
    for _, buckets, counts in rows:
        each = table[buckets, language] - table[buckets].mean(axis=1)
        mean = np.average(each, weights=counts)
        leads.append(mean)
        within.append(np.average((each - mean) ** 2, weights=counts))
    sizes = np.array([c.sum() for _, _, c in rows], float)
    # What a text's own n-grams don't explain of the variation between texts.
    between = max(0.0, float(np.var(leads) - np.mean(np.array(within) / sizes)))
    # n-grams overlap, so their number counts as a third.
    return float(np.average(leads, weights=np.sqrt(sizes))), far * float(np.sqrt(3 * np.mean(within))), far * float(np.sqrt(between)) + SLACK * float(np.mean(leads))


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The factor on logits with the least log loss on the calibration part."""
    if not len(truth):
        return 1.0
    factors = np.geomspace(0.25, 16, 49)
    loss = [-np.log(_softmax(logits * f)[np.arange(len(truth)), truth] + 1e-9).mean() for f in factors]
    return float(factors[int(np.argmin(loss))])


def training_rows(docs: DataFrame, languages: dict[str, int], per_language: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Hashed counts of a sample of documents; docs has doc_id, text, lang."""
    names = sorted(languages)
    share = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(min(1.0, per_language / languages[name])))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = docs.where(F.col("lang").isin(names)).where(draw < share[F.col("lang")])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_thinned(*counted(t)) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b.tobytes() for b, _ in pairs], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in pairs], pa.binary())],
                ["lang", "buckets", "counts"],
            )

    found = chosen.select("lang", "text", "doc_id").mapInArrow(_three(reduce), "lang string, buckets binary, counts binary")
    number = {name: k for k, name in enumerate(names)}
    rows = [(number[r["lang"]], np.frombuffer(bytes(r["buckets"]), np.int32), np.frombuffer(bytes(r["counts"]), np.int32)) for r in found.collect()]
    return sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))


def _thinned(buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(buckets) <= TRAIN_BUCKETS:
        return buckets, counts
    kept = np.sort(np.argsort(buckets.astype(np.uint32) * np.uint32(0x85EBCA6B), kind="stable")[:TRAIN_BUCKETS])
    return buckets[kept], counts[kept]


def _three(reduce):
    return lambda batches: reduce(b.select(["lang", "text"]) for b in batches)


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows where learn holds and lang is not null."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (learn if learn is not None else F.lit(True)).alias("learn"))
    rows = rows.where("learn and lang is not null and doc_id is not null and text is not null").drop("learn")
    languages = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32), np.zeros(0), np.zeros(0), np.zeros(0))
    return train(sorted(languages), training_rows(rows, languages, max(1, min(per_language, TRAIN_ROWS // len(languages)))))


@lru_cache(2)
def _loaded(blob: bytes) -> Model:
    return pickle.loads(blob)


def predict_column(spark, model: Model):
    """A column function from text to language, score and whether the prediction is accepted."""
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    @F.arrow_udf(PREDICTED)
    def of(column: pa.Array) -> pa.Array:
        own, names, scores, kept = _loaded(shared.value), [], [], []
        for a, b in row_slices(column, 1 << 20):
            x, y, z = own.predict(as_bytes(column.slice(a, b - a)))
            names += x
            scores += y.tolist()
            kept += z.tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], fields=list(_PREDICTED))

    return of


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of documents that nothing is learned from; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score, accepted."""
    model = fit(docs, ~held_out(id_col), id_col, text_col, lang_col)
    found = texts(docs, id_col, text_col).select("doc_id", held_out().alias("held_out"), predict_column(docs.sparkSession, model)("text").alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.accepted")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language."""
    from stratagrid.session import load

    return languages_of(load(spark, sf_dir, "documents"))
