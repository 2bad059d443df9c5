import math
import random

import numpy as np
import pytest

from stratagrid.llm import quality
from tests.llm.test_operators import odd_table


def slow_estimate(rows, rounds=500):
    """The same model, document by document in plain Python."""
    bad = [0.95 if 2 * sum(r) > len(r) else 0.3 if any(r) else 0.001 for r in rows]
    for _ in range(rounds):
        share = min(max(sum(bad) / len(rows), 1e-9), 1 - 1e-9)
        hits = [(sum(b for b, r in zip(bad, rows, strict=True) if r[j]) + 8) / (sum(bad) + 10) for j in range(3)]
        alarms = [(sum(1 - b for b, r in zip(bad, rows, strict=True) if r[j]) + 1) / (len(rows) - sum(bad) + 100) for j in range(3)]
        new = []
        for r in rows:
            p = share * math.prod(h if x else 1 - h for h, x in zip(hits, r, strict=True))
            q = (1 - share) * math.prod(a if x else 1 - a for a, x in zip(alarms, r, strict=True))
            new.append(p / (p + q))
        if max(abs(a - b) for a, b in zip(new, bad, strict=True)) < 1e-10:
            break
        bad = new
    return share, hits, alarms, bad


def _drawn(rng, n, share, hits, alarms):
    truth = [rng.random() < share for _ in range(n)]
    return truth, [tuple(int(rng.random() < (hits if t else alarms)[j]) for j in range(3)) for t in truth]


def test_accuracies_against_a_slow_version_and_the_truth():
    rng = random.Random(4)
    truth, rows = _drawn(rng, 3000, 0.1, (0.9, 0.7, 0.8), (0.01, 0.03, 0.02))
    different = sorted(set(rows))
    n = np.array([rows.count(r) for r in different], float)
    found = quality.estimate(np.array(different, float), n)
    share, hits, alarms, bad = slow_estimate(rows)
    assert found.bad == pytest.approx(share, abs=1e-6)
    assert found.hits == pytest.approx(hits, abs=1e-6) and found.false_alarms == pytest.approx(alarms, abs=1e-6)
    assert found.posterior(np.array(rows, float)) == pytest.approx(bad, abs=1e-6)
    for j in range(3):
        right = sum(r[j] == t for r, t in zip(rows, truth, strict=True)) / 3000
        assert found.accuracy[j] == pytest.approx(right, abs=0.02)


def test_patterns_of_all_kinds():
    rng = random.Random(5)
    _, shouting = _drawn(rng, 2000, 0.08, (0.9, 0.8, 0.7), (0.005, 0.01, 0.01))
    _, table = _drawn(rng, 2000, 0.05, (0.95, 0.9, 0.8), (0.002, 0.01, 0.01))
    counts = {}
    for a, b in zip(shouting, table, strict=True):
        v = sum(x << j for j, x in enumerate(a)) + (sum(x << j for j, x in enumerate(b)) << 6)
        counts[v] = counts.get(v, 0) + 1
    bad = quality.posteriors(counts)
    s, t = slow_estimate(shouting)[3], slow_estimate(table)[3]
    for a, b, p, q in zip(shouting, table, s, t, strict=True):
        v = sum(x << j for j, x in enumerate(a)) + (sum(x << j for j, x in enumerate(b)) << 6)
        assert bad[v] == pytest.approx(1 - (1 - p) * (1 - q), abs=2e-3)
    # A labeller that votes often and alone is no sign of badness.
    lone = quality.posteriors({0: 9000, 1: 1000})
    assert lone[1] < 0.5 and lone[0] < 0.01


def _labelled(rng):
    plain = ["river", "stone", "garden", "walked", "slowly", "because", "evening", "market", "letter", "found", "under", "window", "green", "paper", "while", "music"]
    words = lambda n: [f"{rng.choice(plain)}{rng.randrange(20)}" for _ in range(n)]
    rows, marks = [], []
    for k in range(300):
        rows.append((k, " ".join(words(60)) + "."))
        marks.append((k, 1, 0))
    for k in range(300, 340):
        own = words(50)
        own[3], own[30] = rng.choice(["blarg", "zonk", "frump"]), rng.choice(["blarg", "zonk", "frump"])
        rows.append((k, " ".join(own)))
        marks.append((k, 0, 1 if k < 330 else None))
    # Ten copies of one toxic text are one document, so its words are not learned.
    rows += [(k, "a text with oddword and many other usual words in it " + " ".join(words(20)) if k == 400 else None) for k in range(400, 410)]
    rows = [(k, t if t is not None else rows[340][1]) for k, t in rows]
    marks += [(k, 0, 1) for k in range(400, 410)]
    return rows, marks


def test_learned_words_against_brute_force(spark):
    rows, marks = _labelled(random.Random(6))
    got = quality.learned_words(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    toxic_of = {k: x for k, _, x in marks if x is not None}
    seen = {}
    for k, t in rows:
        if k in toxic_of:
            words = quality.lower_words(t.encode())
            for w in {w for w in words if len(w) > 2}:
                seen.setdefault(w, {}).setdefault(quality.sketch(words), set()).add(toxic_of[k])
    want = []
    for w, own in seen.items():
        toxic = sum(max(x) for x in own.values())
        if toxic >= 5 and toxic >= 0.9 * len(own):
            want.append(w)
    assert got == sorted(want) and {b"blarg", b"zonk", b"frump"} <= set(got) and b"oddword" not in got


def test_rejects_junk_and_rude_texts(spark):
    rows, marks = _labelled(random.Random(7))
    rows += [(1000 + k, " ".join(["BUY NOW!!! $$$ ### CLICK"] * 15)) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality.quality(table, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert {k for k, r in found.items() if r["keep"]} == {k for k, _ in rows if k < 300 or 400 <= k < 410}
    assert all("abusive" in found[k]["votes"] for k in range(330, 340))
    # Without labels nothing is known to be abusive.
    assert all(r["keep"] for r in quality.quality(table).where("doc_id < 400").collect())


def test_scores_are_those_of_the_scorer(spark):
    table = odd_table(spark)
    scorer = quality.fit(quality.texts(table))
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in quality.quality(table).collect():
        m = quality.measure((texts[r["doc_id"]] or "").encode(), frozenset())
        if m is None:
            assert r["score"] == 0 and not r["keep"]
        else:
            at, value = quality.features(m)
            logit = scorer.bias + sum(scorer.weights[a] * v for a, v in zip(at.tolist(), value.tolist(), strict=True))
            assert r["score"] == pytest.approx(1 / (1 + math.exp(min(logit, 40))), abs=1e-6)
