import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratagrid.llm import chat, langid, licenses, masked, neighbours, quality, store
from stratagrid.session import fresh_path

ODD = [None, "", "  \n", "日本語 été", "a " * 4000, "same text here", "same text here"]


def odd_table(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, and a column that clashes."""
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(None, "no id at all", 2), (5, "same text here", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


def test_odd_licenses(spark):
    assert licenses.scan(odd_table(spark)).count() == 9
    assert licenses.scan(odd_table(spark).limit(0)).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(400, 10)))]
    rows[7] = (7, rows[50][1])
    rows[9] = (9, rows[50][1])
    bad = [(1000, None), (1050, [0.0] * 10), (1100, [float("nan")] * 10)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect()}
    vectors = np.array([v for _, v in rows])
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    assert len(got) == 8 * 5
    hits = 0
    for q in range(0, 400, 50):
        scores = unit @ unit[q]
        best = sorted((k for k in range(400) if k != q), key=lambda k: (-round(scores[k], 12), k))[:5]
        hits += len({got[q, r][0] for r in range(1, 6)} & set(best))
        assert all(abs(got[q, r][1] - scores[got[q, r][0]]) < 1e-12 for r in range(1, 6))
    assert hits >= 0.9 * 40
    assert [got[50, 1][0], got[50, 2][0]] == [7, 9]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_store_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = ODD + [" ".join(rng.choice(["Word", "été", "x-1,", "<|endoftext|>", "it's", "日本"]) for _ in range(rng.choice([3, 40, 3000]))) for _ in range(40)]
    texts += [texts[-1], texts[-1]]
    path = fresh_path(spark, "store-test")
    store.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    tokenizer, start = Tokenizer.from_file(store.tokenizer_path()), 0
    sums = {r["doc_id"]: r for r in store.document_sums(spark, path).collect()}
    whole = {r["doc_id"]: r["ids"] for r in store.read_documents(spark, path).collect()}
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert whole[k] == ids
        assert (sums[k]["start"], sums[k]["n_tokens"], sums[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert store.verify_manifest(spark, path)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_texts(spark, empty):
    table = odd_table(spark).limit(0) if empty else odd_table(spark)
    n = table.count()
    found = masked.pseudo_likelihood(table).collect()
    assert len(found) == n
    assert all(r["log_prob"] <= 0 and (r["n_tokens"] > 0 or r["mean_log_prob"] is None) for r in found)
    judged = quality.quality(table).collect()
    assert len(judged) == n
    assert {r["doc_id"] for r in judged if not r["keep"]} >= ({0, 1, 2} if n else set())
    path = fresh_path(spark, "odd")
    store.write_store(table, path)
    assert store.document_sums(spark, path).count() == n
    assert store.verify_manifest(spark, path)
    spoken = langid.languages_of(table.withColumn("lang", F.lit("zz"))).collect()
    assert len(spoken) == n
    assert all(r["lang_pred"] == "und" for r in spoken if r["doc_id"] in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in spoken)


def test_chat_against_brute_force(spark):
    rng = random.Random(6)
    bits = [*chat.CONTROLS, chat.ESCAPE, "hi", " ", "\n", "été", "日本"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for c in range(20) for t in range(rng.randrange(1, 6))]
    rows += [(50, 0, "assistant", None), (50, 1, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_conversations(table)).collect():
        own = [(role, text or "") for c, _, role, text in rows if c == r["conv_id"]]
        learned = "".join(text for role, text in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for _, _, _, text in rows:
        safe = chat.escape(text or "")
        assert chat.unescape(safe) == (text or "") and not any(c in safe for c in chat.CONTROLS)
    assert chat.format_conversations(table.limit(0)).count() == 0


def _damaged(spark, path, table, change):
    """The store with one of its tables changed."""
    copy = fresh_path(spark, "damaged")
    for name in ("chunks", "recipes", "manifest"):
        rows = spark.read.parquet(f"{path}/{name}")
        (change(rows) if name == table else rows).write.parquet(f"{copy}/{name}")
    return copy


def test_damaged_stores_raise(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(900)) for _ in range(12)]
    path = fresh_path(spark, "store-damage")
    store.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    assert store.verify_manifest(spark, path) and store.document_sums(spark, path).count() == 12
    chunks = spark.read.parquet(f"{path}/chunks").orderBy("digest").collect()
    victim = bytes(chunks[len(chunks) // 2]["digest"])
    lost = _damaged(spark, path, "chunks", lambda t: t.where(F.col("digest") != F.lit(victim)))
    altered = _damaged(spark, path, "chunks", lambda t: t.withColumn("data", F.when(F.col("digest") == F.lit(victim), F.concat(F.lit(b"\x07\x00"), F.expr("substring(data, 3)"))).otherwise(F.col("data"))))
    for broken in (lost, altered):
        with pytest.raises(Exception, match="chunk"):
            store.document_sums(spark, broken).collect()
    with pytest.raises(Exception, match="missing"):
        store.read_documents(spark, lost).collect()
    cut = _damaged(spark, path, "recipes", lambda t: t.withColumn("chunks", F.when(F.col("doc_id") == 5, F.expr("slice(chunks, 1, size(chunks) - 1)")).otherwise(F.col("chunks"))))
    with pytest.raises(Exception, match="recipe"):
        store.document_sums(spark, cut).collect()
    for change in (lambda t: t.where("doc_id <> 4"), lambda t: t.withColumn("n_tokens", F.col("n_tokens") + F.when(F.col("doc_id") == 2, 1).otherwise(0)), lambda t: t.withColumn("start", F.col("start") + F.when(F.col("doc_id") == 11, 1).otherwise(0))):
        assert not store.verify_manifest(spark, _damaged(spark, path, "recipes", change))
    assert not store.verify_manifest(spark, _damaged(spark, path, "manifest", lambda t: t.withColumn("documents", F.col("documents") + 1)))


def test_odd_conversations(spark):
    hot = [(7, t, "assistant" if t % 2 else "user", f"turn {t} " + "word " * (t % 40)) for t in range(400)]
    rows = hot + [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, None, None, None), (3, 2, "user", "x"), (3, 2, "user", "x"), (3, 2, "assistant", "w"), (4, 0, "user", "")]
    table = spark.createDataFrame([(*r, "clash", b"z") for r in rows], "conv_id long, turn long, role string, text string, tie string, ids binary").repartition(5)
    parts = chat.format_conversations(table)
    got = {r["conv_id"]: r for r in chat.read_back(parts).collect()}
    assert set(got) == {7, None, 3, 4}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", hashlib.sha256((x[3] or "").encode()).hexdigest()))
        whole = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        learned = "".join(text or "" for _, _, role, text in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_a_conversation_is_parts_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TOKENS", 200)
    rows = [(1, t, "user", "some words to say " * 5) for t in range(600)]
    parts = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    # Ranges that are as small as here would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = parts.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1
    assert chat.read_back(parts).collect()[0]["n_turns"] == 600


def test_store_learns_words_without_the_punctuation_behind_them():
    own = store.Encoder(store.tokenizer_path())
    docs = ["", None, "word, word. word! word; Word? word!! word", "a, <|endoftext|> <|endoftext|>. |a| a|", "it's, don't! é, é. ŉ, 1, (a). ,", "中, \x00a, b　c,"]
    ids, ends = own.encode(pa.array(docs), 1)
    for text, a, b in zip(docs, [0, *ends[:-1]], ends, strict=True):
        assert ids[a:b].tolist() == [*own.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    assert "word" in own.place and not {"word,", "word.", "word!", "word;"} & own.place.keys()


def test_words_that_differ_by_case_are_encoded_once():
    own = store.Encoder(store.tokenizer_path())
    own.encode(pa.array(["Some words, SOME Words,", "some words! wordS"]), 1)
    assert set(own.place) == {"", "some", "words", ",", "!"}
    # Where small letters would give other ids: marks that compose with them alone, and special tokens in capitals.
    texts = [f"{a}{m} {a.lower()}{m} {a}̖{m} x" for a in "HJTWY" for m in "̱̌̈̊̈́"]
    texts += ["<|STARTOFTEXT|> a", "A <|EndOfText|>B", "<|startoftext|>A", "İ I ŉ ſ K", "ÀÉ Éa, ß. ÿ! É", "It'S I'LL X" + "'s" * 3]
    texts += [chr(c) + "a" + chr(c) + "." for c in range(0xC0, 0x180)]
    for each in ([t] for t in texts), [texts]:
        for part in each:
            ids, ends = own.encode(pa.array(part), 1)
            want = [own.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in part]
            assert ids.tolist() == [i for x in want for i in x] and ends.tolist() == np.cumsum([len(x) for x in want]).tolist()
