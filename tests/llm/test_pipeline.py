import hashlib
import random
import re

import corpus_pipeline
from tests.llm.test_similar import brute_groups
from tests.llm.test_wumanber import brute as brute_windows

EN = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if".split()
FR = "le la les de des et un une est que dans pour qui sur au par plus ne pas avec ce il sont mais nous vous elle être cette leur bien où donc très été même aussi fait".split()
RUDE = ["blarg", "zonk", "frump", "skreet"]


def _table(spark, folder):
    """Documents in two languages, junk, rude ones, near copies and benchmark passages, as files; and the rows."""
    rng = random.Random(21)

    def prose(words, n):
        return " ".join(rng.choice(words) + (rng.choice(["", "", "er", "ion", "ais"]) if words is FR else rng.choice(["", "", "ing", "ed"])) for _ in range(n)) + "."

    rows, labels = [], []
    for k in range(240):
        lang = "en" if k % 3 else "fr"
        rows.append((k, prose(EN if lang == "en" else FR, rng.choice([60, 90, 140])), lang))
    bench = [(k, " ".join(f"item{k}word{j}" for j in range(14))) for k in range(6)]
    kinds = {}
    for k in range(240, 270):
        rows.append((k, " ".join(w.upper() + "!!" for w in prose(EN, 60).split()), "en"))
        kinds[k] = "shout"
    for k in range(270, 300):
        words = prose(EN, 80).split()
        for _ in range(8):
            words[rng.randrange(80)] = rng.choice(RUDE)
        rows.append((k, " ".join(words), "en"))
        kinds[k] = "rude"
        labels.append((k, 0, 1))
    labels += [(k, 1, 0) for k in range(0, 240, 2)]
    for k in range(300, 320):
        words = rows[k - 300][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), rows[k - 300][2]))
        kinds[k] = "copy"
    for k in range(320, 330):
        rows.append((k, prose(EN, 50) + " " + bench[k % 6][1] + " " + prose(EN, 30), "en"))
        kinds[k] = "leak"
    rows += [(400, None, "en"), (401, "", "en"), (402, " \n ", None), (None, prose(EN, 70), "en"), (7, rows[7][1], rows[7][2])]
    rows += [(403, "日本語の文章です。これはテストであり、学習した言語ではない。" * 6, None)]
    data = [(a, b, c, "src", len(b or ""), "clash") for a, b, c in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _stage string"
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench, kinds


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, bench, kinds = _table(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def step(name, table):
        out = stage[name](spark, table, folder)
        assert out.columns == docs.columns
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        return spark.read.parquet(path)

    def ids(table):
        return [r["doc_id"] for r in table.select("doc_id").collect()]

    good = step("quality classifier", docs)
    gone = {k for k, t, _ in rows if kinds.get(k) in ("shout", "rude") or not (t or "").split()}
    kept = set(ids(good))
    assert not kept & gone and len({k for k, _, _ in rows} - gone - kept) <= 2
    assert {r["_stage"] for r in good.select("_stage").collect()} == {"clash"}

    spoken = step("language ID", good)
    assert 403 not in ids(spoken) and len(kept - {403} - set(ids(spoken))) <= 2

    single = step("near-dedup", spoken)
    left = [(r["doc_id"], r["text"]) for r in spoken.collect()]
    with_id = sorted({x for x in left if x[0] is not None})
    group = brute_groups(with_id)
    assert sorted(ids(single), key=str) == sorted([k for k, _ in left if k is None or group[k] == k], key=str)

    clean = step("benchmark decontamination", single)
    assert sorted(ids(clean), key=str) == sorted([r["doc_id"] for r in single.collect() if not brute_windows(r["text"], bench)[4]], key=str)

    import sentencepiece

    from stratagrid.llm.pieces import model_path

    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    text_of = {r["doc_id"]: r["text"] for r in clean.collect()}
    final = stage["SentencePiece encoding and decoding"](spark, clean, folder).collect()
    assert len(final) == clean.count()
    for r in final:
        own = library.encode(text_of[r["doc_id"]])
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, final), key=str)


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stage_names():
    assert [re.sub(r"[^a-z]", "", n.lower())[:4] for n, _ in corpus_pipeline.STAGES] == ["qual", "lang", "near", "benc", "sent"]
