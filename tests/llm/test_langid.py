import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from stratagrid.llm import langid

WORDS = {
    "aa": "the house of water and stone was old with every little garden there".split(),
    "bb": "der hund und das wasser nicht schön ist aber immer noch kalt".split(),
    "cc": "la maison était très belle avec les fleurs dans une grande ville".split(),
}
OTHER = "talo vesi kivi vanha puutarha ystävä yksi kaksi hyvä päivä kiitos".split()


def _texts(rng, words, n, size):
    return [" ".join(rng.choice(words) for _ in range(rng.choice(size))) for _ in range(n)]


def test_held_out_texts_and_rejection(spark):
    rng = random.Random(12)
    rows = []
    for lang, words in WORDS.items():
        rows += [(t, lang) for t in _texts(rng, words, 240, [12, 30, 80, 400])]
    rng.shuffle(rows)
    rows = [(k, t, lang) for k, (t, lang) in enumerate(rows)]
    rows += [(5000 + k, t, None) for k, t in enumerate(_texts(rng, OTHER, 60, [30, 80, 400]))]
    table = spark.createDataFrame([(*r, 9.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r["doc_id"]: r for r in langid.languages_of(table).collect()}
    held = [k for k in range(720) if got[k]["held_out"]]
    assert len(held) == sum(zlib.crc32(str(k).encode()) % 4 == 2 for k in range(720))
    assert sum(got[k]["lang_pred"] == rows[k][2] for k in held) >= 0.98 * len(held)
    assert sum(got[k]["accepted"] for k in held) >= 0.98 * len(held)
    # A language that was not learned.
    assert sum(got[5000 + k]["accepted"] for k in range(60)) <= 6


def test_letters():
    cases = ["", None, "123 ½ ² ³ Ⅷ _ ①", "!?", "ª", "é", "日", "١٢", "a", "ʰ", "\U0001d400"]
    assert langid.have_letters([None if c is None else c.encode() for c in cases]).tolist() == [False, False, False, False, True, True, True, False, True, True, True]


def test_sums_against_a_slow_version():
    rng = np.random.default_rng(1)
    model = langid.train(["x", "y", "z"], [(k % 3, *langid.counted(f"word{k} some text {k}".encode())) for k in range(30)])
    rows = [b"some text", None, b"", b"a", ("été " * 50).encode(), bytes(rng.integers(97, 123, 3000, dtype=np.uint8))]
    total, count = model.sums(rows)
    kept, langid.CELLS = langid.CELLS, 3
    try:
        again, same = model.sums(rows)
    finally:
        langid.CELLS = kept
    for k, text in enumerate(rows):
        buckets, n = langid.counted(text)
        assert count[k] == same[k] and abs(count[k] - n.sum()) <= 3
        assert np.allclose(again[k], total[k])
        if count[k] == n.sum():
            assert np.allclose(total[k], (model.table[buckets] * n[:, None]).sum(axis=0), rtol=1e-4, atol=1e-4)


def test_a_huge_text_takes_bounded_memory():
    import tracemalloc

    languages = [f"l{k}" for k in range(40)]
    zeros = np.zeros(40)
    model = langid.Model(languages, np.ones((1 << langid.BUCKET_BITS, 40), np.float32), zeros, zeros, zeros, zeros)
    text = b"some words of a very long text " * 60_000
    tracemalloc.start()
    model.predict([text])
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, "aa"), (2, "", None), (3, "123 ½", "aa"), (None, "word", "aa"), (5, "word", "aa"), (5, "word", None)], "doc_id long, text string, lang string")
    got = langid.languages_of(rows).collect()
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in got if r["doc_id"] in (1, 2, 3)] == [("und", 0.0, False)] * 3
    assert all(r["lang_pred"] == "aa" and r["score"] == 1 and not r["held_out"] for r in got if r["doc_id"] is None)
    assert langid.languages_of(rows.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.languages_of(rows.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
