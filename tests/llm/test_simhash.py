import random

import xxhash

from stratagrid.llm.simhash import block_count, fingerprint, near_duplicates, run_links


def brute_print(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[x] = root[y] = min(x, y, key=lambda k: prints[k][0])
    return {p[0]: prints[find(k)][0] for k, p in enumerate(prints)}


def test_documents(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    rows = []
    for k in range(150):
        base = [word() for _ in range(rng.choice([0, 1, 3, 4, 5, 60, 200]))]
        for c in range(rng.choice([1, 1, 3])):
            copy = list(base)
            if copy and c:
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(copy).upper() if c == 2 else "\t".join(copy), "x"))
    rows += [(2000, None, "x"), (2001, " \x0b é ÀÉ", "x"), (2002, "", "x"), (rows[3][0], rows[3][1], "x"), (None, rows[3][1], "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = near_duplicates(table).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, _ in rows}
    want = brute_components([(d, brute_print(t)) for d, t in texts.items() if d is not None])
    for r in got:
        assert r["fingerprint"] & (1 << 64) - 1 == brute_print(texts[r["doc_id"]]) == fingerprint((texts[r["doc_id"]] or "").encode())
        assert r["component_id"] == want[r["doc_id"] if r["doc_id"] is not None else rows[3][0]]
    assert near_duplicates(table.limit(0)).count() == 0


def test_dense_and_chained_fingerprints(spark):
    import numpy as np

    from stratagrid.llm.simhash import components_of

    rng = random.Random(2)
    prints = set()
    center = rng.getrandbits(64)
    for _ in range(400):
        prints.add(center ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 9))) & (1 << 64) - 1)
    x = rng.getrandbits(64)
    for _ in range(60):  # a chain
        prints.add(x)
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
    prints |= {rng.getrandbits(64) for _ in range(300)}
    rows = [(k, int(np.uint64(p).view(np.int64))) for k, p in enumerate(sorted(prints))]
    table, want = spark.createDataFrame(rows, "doc_id long, fingerprint long"), brute_components([(k, p & (1 << 64) - 1) for k, p in rows])
    for longest in (20_000, 50, 2):  # with keys split or not
        got = {r["doc_id"]: r["component_id"] for r in components_of(table, longest=longest).collect()}
        assert got == want


def test_block_count():
    assert [block_count(n) for n in (1, 1000, 170_000, 10**8, 10**12)] == [5, 5, 6, 7, 8]
    import numpy as np

    a, b = run_links(np.zeros(3, np.int64), np.array([0, 15, 1 << 40], np.uint64), np.array([5, 6, 7]))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(5, 6), (6, 7), (5, 7)} or len(a) >= 2
