import random

import numpy as np

from chatterloom.llm import spans

EXTRA = ", rep string, n int, h int, label string, source int, class int"
JUNK = ("z", 0, 0, "z", 0, 0)


def made(rnd):
    base = ["".join(rnd.choice("abcdef ж中\U0001f525") for _ in range(400)) for _ in range(6)]
    texts = [None, "", "x" * 300, "x" * 250, "q", "ab" * 700, "ba" * 300 + "x" * 180, "x" * 3000, base[0][:30] + "x" * 64 + base[1][:90], base[0][:30] + "x" * 900 + base[1][:90], "x" * 72 + base[1][:40], "abc" * 40 + base[2] + "abc" * 300]
    for _ in range(40):
        a, b = rnd.choice(base), rnd.choice(base)
        i, n = rnd.randrange(300), rnd.choice([60, 90, 99, 100, 101, 140, 300])
        texts.append("".join(rnd.choice("uvwxyz") for _ in range(rnd.randrange(80))) + a[i : i + n] + "|" + b[: rnd.choice([0, 99, 130])])
    return texts + [texts[20], texts[20]]


def test_spans_against_brute_force(spark):
    texts = made(random.Random(3))
    rows = [(i, t, *JUNK) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[15:18], "id long, t string" + EXTRA)
    pairs, members = spans.shared(df, "id", "t")
    got = [(r.id_a, r.id_b) for r in spans.document_pairs(pairs, members).collect()]
    grams = [set() if not t else {t[i : i + 100] for i in range(len(t) - 99)} for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] & grams[j]}
    assert set(got) == want and len(got) == len(want)
    assert {r.id: r.n_links for r in spans.links(pairs, members).collect()} == {i: sum(i in p for p in want) for i, t in enumerate(texts) if t and len(t) >= 100}
    length = {}
    for r in spans.stretches(pairs, members).collect():
        length[r.id] = length.get(r.id, 0) + r.length
    for i, t in enumerate(texts):
        others = set().union(*(g for j, g in enumerate(grams) if j != i))
        inside = [False] * len(t or "")
        for p in range(len(t or "") - 99):
            if t[p : p + 100] in others:
                inside[p : p + 100] = [True] * 100
        assert length.get(i, 0) == sum(inside), i
    assert spans.shared(df.limit(0), "id", "t")[0].count() == 0


def test_hot_seed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK_ROWS", 3)
    rnd = random.Random(4)
    common = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    df = spark.createDataFrame([(i, f"{i:05d}" * 5 + common) for i in range(20)], "id long, t string")
    assert spans.document_pairs(*spans.shared(df, "id", "t")).distinct().count() == 190


def test_results_come_from_chains(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abcdefghij" * 3 + "0123456789" * 12), (2, "zyx" * 9 + "0123456789" * 12)], "id long, t string")
    assert spans.shared(df, "id", "t")[0].count() == 1
    monkeypatch.setattr(spans, "align", lambda *_: ([], []))
    assert spans._align_pair([0], [30 << 32 | 30], [27 << 32 | 27], [0], ["x" * 200], [0], ["x" * 200], 64, 100) == ([], [], [])


def test_fuzzy_passages(spark):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1200))
    other = base[:200] + "Q" + base[201:330] + base[337:480] + "inserted " + base[480:620] + "".join(rnd.choice("0123456789") for _ in range(400)) + base[800:]
    df = spark.createDataFrame([(1, "A" * 30 + base), (2, "B" * 55 + other)], "id long, t string")
    got = [tuple(r)[2:] for r in spans.passages(spans.shared(df, "id", "t")[0]).orderBy("from_a").collect()]
    assert [(*p[:4], p[4] <= 17) for p in got] == [(30, 30 + 620, 55, 55 + 622, True), (30 + 800, 1230, 55 + 622 + 400, 55 + 622 + 800, True)] and got[0][4] > 9


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = (np.array([rnd.randrange(4) for _ in range(rnd.randrange(30))], np.uint32) for _ in range(2))
        assert spans.edits(a, b) == brute_edits(a.tolist(), b.tolist())


def test_chains():
    got = spans.chains([(0, 0), (30, 30), (10, 500), (64, 64)], 64)
    assert got == [(128.0, [(0, 0), (30, 30), (64, 64)]), (64.0, [(10, 500)])]
    rnd = random.Random(2)
    matches = [(rnd.randrange(500), rnd.randrange(500)) for _ in range(200)]
    out = spans.chains(matches, 16)
    assert sorted(m for _, path in out for m in path) == sorted(set(matches))
    assert all(p[0] < q[0] and p[1] < q[1] for _, path in out for p, q in zip(path, path[1:]))


def test_seeds_of_stretches():
    h, at, to = spans.seeds("x" * 3000, 64, 100)
    assert len(at) <= 160 and at.min() == 0 and to[at == 0] == at.max() == 3000 - 64
