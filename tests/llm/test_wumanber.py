import hashlib
import random
import re

from stratagrid.llm.wumanber import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item_id, item in items:
        own = WORD.findall((item or "").translate(LOWER))
        size = min(10, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1):
            if size and tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "to", "été", "x1", "Zebra", "naïve", "b-c", "日本"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(rng.choice([1, 3, 9, 10, 11, 30]))) for k in range(30)] + [(99, None), (98, ""), (97, "..."), (5, line(12))]
    items = [x for x in items if x[1] is None or len(WORD.findall(x[1])) != 1 or x[0] % 2]
    docs = [(k, line(rng.choice([0, 5, 12, 40, 700])) + rng.choice(["", ". ", ", "]) + (rng.choice(items)[1] or "") + "; " + line(4), "z") for k in range(120)]
    docs += [(500, None, "z"), (501, "", "z"), (502, "?!", "z"), (None, "the of", "z"), (7, docs[7][1], "z")]
    table = spark.createDataFrame(docs, "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 40):
        from stratagrid.llm import wumanber

        found = wumanber.with_findings(table, bench, block_words=block)
        got = found.select("doc_id", "text", "found.n_words", wumanber.hit_words(found["found"]).alias("n"), "found.items").collect()
        assert len(got) == len(docs)
        for r in got:
            want = brute(r["text"], items)
            assert (r["n_words"], r["n"], len(r["items"])) == want[:3]
    got = contamination(table, bench).collect()
    texts = {d[0]: d[1] for d in docs}
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(texts[r["doc_id"]], items)
    assert contamination(table, bench.limit(0)).where("contaminated").count() == 0
    assert contamination(table.limit(0), bench).count() == 0
