import math
import random

import numpy as np
import pytest

from stratagrid.llm import masked


def test_gradient_against_differences():
    rng = np.random.default_rng(4)
    w = {k: x.astype(float) for k, x in masked.fresh_weights(np.arange(masked.CLASSES)).items()}
    w["out"] = rng.normal(0, 0.3, w["out"].shape)
    numbers = np.r_[np.zeros(4), rng.integers(1, masked.CLASSES, 12), np.zeros(4)].astype(np.int16)
    places = np.arange(4, 16)
    rows, truth = masked.contexts(numbers, places), numbers[places].astype(int)
    _, slope = masked.loss_and_gradient(w, rows, truth)
    touched = {"window": [(int(rows[3, 2]), 5), (int(rows[0, 0]), 1), (int(rows[11, 7]), 23)], "out": [(3, int(truth[1])), (23, 0)], "bias": [(int(truth[2]),), (9,)]}
    for name, places_ in touched.items():
        for at in places_:
            kept, loss = w[name][at], []
            for step in (1e-5, -1e-5):
                w[name][at] = kept + step
                loss.append(masked.loss_and_gradient(w, rows, truth)[0])
            w[name][at] = kept
            assert slope[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-7)


def slow_log_prob(text, own, size, total_of, weights):
    """Word by word, class by class."""
    words = (text or "").lower().encode().split()
    classes = [own.class_of(w) for w in words]
    padded = [0] * 4 + classes + [0] * 4
    out = 0.0
    for k, (w, c) in enumerate(zip(words, classes, strict=True)):
        around = padded[k : k + 4] + padded[k + 5 : k + 9]
        hidden = np.tanh(sum(weights["window"][x + j * masked.CLASSES].astype(float) for j, x in enumerate(around)))
        logits = hidden @ weights["out"].astype(float) + weights["bias"]
        out += logits[c] - math.log(sum(math.exp(x) for x in logits))
        out += math.log(total_of[w] / size[c])
    return out


@pytest.fixture
def few_held(monkeypatch):
    monkeypatch.setattr(masked, "HELD_WORDS", 150)


def test_scores_against_brute_force(spark, few_held):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2) + rng.choice("xyz") * rng.randint(0, 3) + rng.choice(["", "", "ing", "ed"])
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(60)] + [None, "", " \n ", "Once upon A time"]
    texts += [texts[3], texts[7], texts[7]]
    rows = [(k, t, 0.5) for k, t in enumerate(texts)] + [(None, texts[8], 0.1), (4, texts[4], 0.2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, log_prob double")
    got = masked.pseudo_likelihood(table).collect()
    assert len(got) == len(rows)

    counts = masked.word_table(table.select("doc_id", "text"))
    total_of = {bytes(r["word"]): r["n"] for r in counts.collect()}
    own, size, limit = masked.held_words(counts)
    assert len(total_of) > 150 >= len(own.logs) > 50 and limit >= 1
    assert sum(size) == sum(total_of.values())
    held = spark.sparkContext.broadcast(masked.pickle.dumps(own))
    weights = masked.fresh_weights(size)
    for part in range(masked.ROUNDS):
        weights = masked._train_round(table.select("doc_id", "text"), held, weights, part, masked.ROUNDS)
    want = {k: slow_log_prob(t, own, size, total_of, weights) for k, t, _ in rows}
    for r in got:
        assert r["log_prob"] == pytest.approx(want[r["doc_id"]], abs=2e-3)
        text = {k: t for k, t, _ in rows}[r["doc_id"]]
        n = len((text or "").split())
        assert r["n_tokens"] == n and (r["mean_log_prob"] is None) == (n == 0)
    # Within a class the words' probabilities add up to one.
    for c in {own.class_of(w) for w in total_of}:
        assert sum(n / size[c] for w, n in total_of.items() if own.class_of(w) == c) == pytest.approx(1)


def test_learns_order_and_counts(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["red", "green", "blue", "grey"] * rng.randint(6, 9)) + f" only{k % 30 if k < 60 else k}") for k in range(90)]
    rows += [(900, "red green blue grey red green blue grey red green"), (901, "green green red blue grey grey blue red green red")]
    rows += [(902, "red green blue only1"), (903, "red green blue only70"), (904, "red green blue unique")]
    got = {r["doc_id"]: r["log_prob"] for r in masked.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900] > got[901]
    # A word is the likelier the oftener the corpus has it.
    assert got[902] > got[903]
    assert masked.pseudo_likelihood(spark.createDataFrame([(1, None), (2, "  ")], "doc_id long, text string")).collect() == [(1, 0, 0.0, None), (2, 0, 0.0, None)]
