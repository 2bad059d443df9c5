import hashlib
import random

import pytest

from stratagrid.llm.pieces import decode_column, encode_column, encoded_digests, model_path, pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


CASES = [
    "", " ", "  ", "a", " a", "a ", "a  b", "   a   b  ", "a\tb\nc", "▁x▁▁y", "é é ﬁ", "　x", "\x00a\x01", "</s> <s> <0x0A>",
    "😀😀 👩‍👩‍👧 zz", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abababababab" * 9, "    " * 40, "=" * 77, "\n\n\n\n\n" * 7, "ħġẅ ₿𐍈", "x" * 3000,
    "hahahaha hohoho 1111111 2222222 -------- ........", "The quick brown fox; l'été à Köln.",
]


def _random_texts(n):
    rng = random.Random(5)
    pools = ["ab ", "aeiou rstln", "éèàü ß", "abc  \n\t", "01 .,-", "😀𐍈▁ x", "the and ing tion "]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_same_ids_as_the_library(library):
    import pyarrow as pa

    cases = CASES + _random_texts(3000)
    ids, places, counts = pieces(model_path()).encode(pa.array(cases))
    at = 0
    for text, n in zip(cases, counts.tolist(), strict=True):
        own = [i for k in places[at : at + n].tolist() for i in ids[k]]
        at += n
        assert own == library.encode(text), repr(text)
        assert pieces(model_path()).decode(own) == library.decode(own)


def test_columns(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate([None, *CASES])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in encoded_digests(docs, model_path()).collect()}
    for k, text, _ in rows:
        ids = library.encode(text or "")
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = docs.select("text", decode_column(model_path())(encode_column(model_path())("text")).alias("back")).collect()
    assert all(r["back"] == library.decode(library.encode(r["text"] or "")) for r in back)
    assert encoded_digests(docs.limit(0), model_path()).count() == 0
