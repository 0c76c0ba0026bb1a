import math
import random
import sys
import unicodedata
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatterloom.llm import canonical_list, copies, lookalike, mixture, overlap, queries, related_splits, tokens

sys.path.insert(0, str(Path(__file__).parents[1]))

from helpers import check  # noqa: E402

EXTRA = ", id string, rep string, n int, h int, label string, source int, class int"
JUNK = ("z", "z", 0, 0, "z", 0, 0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, oracle, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.ORACLE:
        check(df, oracle, queries.ORACLE[name])
    else:
        assert df.count() > 0 or name in ("p9_mix",)


# p1


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Satire", "Satiｒe", True), ("сat", "cat", True), ("é", "é", True), ("é", "e", False), ("A", "a", False), ("a b", "a b", True), ("a b", "a b", True),
        ("a  b", "a b", False), ("a​b", "ab", True), ("so­ft", "soft", True), ("ﬁx", "fix", True), ("I", "l", False), ("a\nb", "a b", False), ("\U0001f468‍\U0001f33e", "\U0001f468\U0001f33e", False),
        ("из‑за", "из-за", True),
    ],
)
def test_plain(a, b, same):
    assert (lookalike.plain(a) == lookalike.plain(b)) is same


def test_trie_costs():
    trie = lookalike.Trie(["cat", "cart", "утро", "fix", "\u00e9t\u00e9"])
    assert {w for c, w in trie.near("сa​t")} == {"cat"}
    assert [*trie.near("утрo")] == [(0, "утро")] and [*trie.near("\ufb01x")] == [(0, "fix")] and [*trie.near("e\u200b\u0301t\u00e9")] == [(0, "\u00e9t\u00e9")]
    assert ("cart" in {w for c, w in trie.near("сat", 1)}) and min(c for c, w in trie.near("сat", 1) if w == "cart") == 1
    assert min(c for c, w in trie.near("fox", 1)) == 1 and not [*trie.near("fox")]


def test_spelling_comes_from_the_trie(monkeypatch):
    asked = pd.DataFrame({"token": ["утрo", "\uff43at", "zу"], "plain": [lookalike.plain(x) for x in ("утрo", "\uff43at", "zу")]})
    words = pd.DataFrame({"word": ["утро", "cat", "саt"], "seen": [5, 1, 9]})
    got = lookalike._match(asked, words)
    assert dict(zip(got["token"], got["spelling"])) == {"утрo": "утро", "\uff43at": "cat", "zу": "zy"}
    monkeypatch.setattr(lookalike.Trie, "near", lambda *_: iter(()))
    assert "утро" not in set(lookalike._match(asked, words)["spelling"])


def test_trie_agrees_with_table():
    rnd = random.Random(8)
    chars = ["a", "а", "é", "e", "\u0301", "\u0323", "\u200b", "ﬁ", "f", "i", "ｆ", "у", "y", "ß", "ǆ", "中", "가", "Å", "A"]
    words = {unicodedata.normalize("NFC", "".join(rnd.choice(chars) for _ in range(rnd.randint(1, 4)))) for _ in range(400)}
    words = [w for w in words if lookalike.ordinary(w, lookalike.plain(w))]
    trie = lookalike.Trie(words)
    for _ in range(500):
        token = "".join(rnd.choice(chars) for _ in range(rnd.randint(1, 5)))
        assert {w for _, w in trie.near(token)} == {w for w in words if lookalike.plain(w) == lookalike.plain(token)}, token


def test_look_links(spark):
    texts = ["new cat", "new сat", "new cаt", "New cat", None, "", "new cat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string").withColumn("fld", F.lit("f"))
    assert {r.id: r.n_links for r in lookalike.look_links(lookalike.canonical_texts(df, "fld", "k", "t")).collect()} == {0: 2, 6: 2, 1: 3, 2: 3}


def test_same_look(spark):
    texts = ["new cat", "new сat", "new cаt", "New cat", None, "", "  ", "​", "x" * 50_000, "x" * 49_999 + "х", "new cat"]
    cyr = ["с утро", "c утрo"]
    df = spark.createDataFrame([(i, t, *JUNK) for i, t in enumerate(texts + cyr)], "k long, t string" + EXTRA).withColumn("fld", F.lit("f"))
    forms = lookalike.canonical_texts(df, "fld", "k", "t", keep=True)
    pairs = {(r.id_a, r.id_b) for r in lookalike.same_look_pairs(forms).collect()}
    assert pairs == {(0, 1), (0, 2), (1, 2), (1, 10), (2, 10), (8, 9), (11, 12)}
    by = {r.id: r.canonical_text for r in forms.collect()}
    assert by[1] == "new cat" and by[7] == "" and 4 not in by and by[11] == by[12]
    assert lookalike.canonical_texts(df.limit(0), "fld", "k", "t").count() == 0


def test_ascii_values_that_look_like_a_label(spark, tmp_path):
    labels = [(1, "claim_types", "Cherry\u2011picking"), (2, "claim_types", "Satire or parody"), (3, "ctas", "Send money")]
    values = ["Cherry-picking", "Cherry\u2011picking", "Satire\x07 or parody", "Satire or parody", "Satire or pаrody", "Satire  or parody", "Send\x07 money", '"Satire\tor parody", Cherry-picking', None]
    spark.createDataFrame(labels, "label_id int, tag_field string, label string").write.parquet(f"{tmp_path}/codebook_labels.parquet")
    spark.createDataFrame([(10 + i, None, v) for i, v in enumerate(values)], "message_id long, message string, claim_types string").write.parquet(f"{tmp_path}/{queries.MEGA}.parquet")
    assert {tuple(r) for r in queries.p1_found(spark, str(tmp_path)).collect()} == {("claim_types", 1, 10), ("claim_types", 2, 12), ("claim_types", 2, 14), ("claim_types", 2, 17), ("claim_types", 1, 17)}


# p3


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_overlap_against_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, 4)):
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + [rnd.choice(words)] + w[at:], w[:at] + [rnd.choice(words)] + w[at + 1 :]])
        else:
            w = [rnd.choice(words) for _ in range(rnd.randint(6, 30))]
        rows.append((i, " ".join(w), rnd.choice(["train", "train", "val", "test", None])))
    texts = spark.createDataFrame([(i, t, *JUNK) for i, t, _ in rows] + [(900, None, *JUNK), (901, "", *JUNK)], "k long, t string" + EXTRA)
    split = spark.createDataFrame([(i, s) for i, _, s in rows] + [(900, "train"), (901, "val"), (3, rows[3][2])], "k long, s string")
    got = {tuple(sorted((r.id_train, r.id_other))) for r in overlap.member_pairs(*overlap.cross_split(texts, split, "k", "t", "s")).collect()}
    want = set()
    for i, a, s in rows:
        for j, b, z in rows:
            x, y = a.split(), b.split()
            if i < j and s and z and (s == "train") != (z == "train") and min(len(x), len(y)) >= 8 and brute_lcs(x, y) >= 0.85 * max(len(x), len(y)) - 1e-9:
                want.add((i, j))
    assert got == want and want
    assert overlap.common_subsequence([1, 2, 3, 1], [3, 1, 2, 3]) == brute_lcs([1, 2, 3, 1], [3, 1, 2, 3])
    assert overlap.cross_split(texts.limit(0), split, "k", "t", "s")[0].count() == 0


def test_words_ignore_case_and_script():
    assert overlap.words_of("ВРАЧ Уже Note Ёж") == overlap.words_of("врач уже nоte ёж")
    assert overlap.words_of("a_b-c\u200bd 12,5") == ["a", "b", "cd", "12", "5"]


def test_lists_meet_and_stop_by_the_bounds():
    import numpy as np

    rnd = np.random.default_rng(1)
    table = rnd.integers(0, 140, 1 << 10).astype(np.uint8)
    flat = rnd.integers(0, 60, 240).astype(np.int32)
    lengths = np.full(12, 20)
    flat[20:40] = flat[:20]
    flat[[25, 31, 38]] = [77, 78, 79]
    x = overlap._Ordered(lengths, flat, table, 0.85)
    assert np.all(np.diff(x.mass.reshape(12, 20)) <= 0) and np.allclose(x.need, np.sort(x.mass.reshape(12, 20))[:, :17].sum(1))
    for k in (1, 2, 3):
        rows, keys, infos = overlap.list_keys(lengths, flat, table, 0.85, k)
        assert set(keys[rows == 0]) & set(keys[rows == 1]) and np.all(infos > 0)
        for i, m in enumerate(x.mass.reshape(12, 20)):
            p = min(p for p in range(21) if m[: k - 1].sum() + m[p:].sum() < x.need[i] - 1e-9)
            assert (rows == i).sum() == math.comb(p, k)


def test_bound_and_need_decide():
    import numpy as np
    import pyarrow as pa

    table = np.zeros(1 << 10, np.uint8)
    table[:8] = 255
    common = list(range(8, 25))
    a, b, c = common + [900, 901, 902], common + [0, 1, 2], list(range(8, 22)) + [0, 1, 2, 3, 4, 5]
    got = overlap.similar(pa.array([a, a], pa.list_(pa.int32())), pa.array([b, c], pa.list_(pa.int32())), table, 0.85)
    assert got.tolist() == [True, False]
    assert overlap.masses(np.array([0, 255])).tolist() == [1.0, 1 - 255 / 768] and overlap.masses(np.array([255]))[0] > 2 / 3


def test_links(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text), (2, text.upper()), (3, text + " eleven"), (4, "quite another text with more than eight words in it"), (5, text)], "k long, t string")
    split = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test"), (4, "test"), (5, "train")], "k long, s string")
    got = {r.key: (r.class_id, r.n_links) for r in overlap.links(*overlap.cross_split(df, split, "k", "t", "s")).collect()}
    assert got == {1: (1, 2), 5: (1, 2), 2: (1, 2), 3: (3, 2), 4: (4, 0)}


# p4


def test_mapping(spark):
    ref = spark.createDataFrame([(1, "f", "Send money", ["chip in cash"]), (2, "f", "Open the pinned post", None), (3, "g", "Court record", [])], "label_id int, tag_field string, label string, aliases array<string>")
    cases = {"Send money": None, "send mony": 1, "SEND MONEY": 1, "sendmoney": 1, "money send": 1, "mostly send money": 1, "Chip In Cash": 1, "openthepinnedpost": 2, "Open the pinned pto": 2, "Court record": 0, "pillow storage": 0, "Sеnd money": 1, "": None, None: None, "?!": 0, "q" * 5000: 0}
    rows = [(i, "f", v, *JUNK) for i, v in enumerate(cases)]
    df = spark.createDataFrame(rows + rows, "k long, tag_field string, tag_value string" + EXTRA)
    got = {r.k: r.label_id for r in canonical_list.map_to_list(df, ref, ["k"]).collect()}
    assert got == {i: w for i, (v, w) in enumerate(cases.items()) if w is not None}
    assert canonical_list.map_to_list(df.limit(0), ref, ["k"]).count() == 0
    assert canonical_list.map_to_list(df, ref.limit(0), ["k"]).where("label_id <> 0").count() == 0


def test_token_join_against_all_pairs(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.choice([2, 4, 7, 11, 23, 24, 25, 26, 40]))) for _ in range(60)]

    def typo(w):
        w = list(w)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w))
            kind = rnd.randrange(4)
            if kind == 0 and len(w) > 2:
                del w[at]
            elif kind == 1:
                w.insert(at, rnd.choice("abcd"))
            elif kind == 2:
                w[at] = rnd.choice("abcd")
            elif at:
                w[at - 1], w[at] = w[at], w[at - 1]
        return "".join(w)

    tokens = {typo(w) for w in words for _ in range(5)} | {w[: rnd.randint(1, len(w))] for w in words}
    longest = max(map(len, words))
    got = canonical_list._joined_by_keys(
        spark.createDataFrame([("f", t) for t in tokens], "tag_field string, token string"), spark.createDataFrame([("f", w) for w in set(words)] + [("g", "abc")], "tag_field string, word string"),
        lambda t: canonical_list.token_keys(t, longest), canonical_list.word_keys, canonical_list.token_similarity,
    )
    want = {(t, w): s for t in tokens for w in set(words) if (s := canonical_list.token_similarity(t, w)) > 0}
    # one edit of a token of two letters, and two of one of five, come from words that allow as many
    loose = {p for p in want if allowed_only_by_longer(*p)}
    assert {(r.token, r.word): r.sim for r in got.collect()} == {p: s for p, s in want.items() if p not in loose}


def allowed_only_by_longer(token, word):
    k = canonical_list.distance(token, word, 2)
    few = k > min(canonical_list.allowed(len(token)), canonical_list.allowed(len(word)))
    return few and not set(canonical_list.token_keys(token, 40)) & canonical_list.word_keys(word)


def test_run_join_against_all_pairs():
    rnd = random.Random(7)
    wholes = ["".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (3, 5, 9, 12, 15, 21, 30)]
    lengths = sorted({len(w) for w in wholes})
    for w in wholes:
        for _ in range(60):
            run = list(w[: rnd.choice([len(w), len(w), max(1, len(w) - rnd.randrange(len(w)))])])
            for _ in range(rnd.randint(0, max(1, len(w) // 5))):
                at = rnd.randrange(len(run))
                run[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "q"])
                run = run or ["z"]
            run = "".join(run)
            assert not canonical_list.run_similarity(run, w) or canonical_list.run_keys(run, lengths) & canonical_list.whole_keys(w), (run, w)


def test_unmatched_values(spark):
    ref = spark.createDataFrame([(1, "f", "Send money", None)], "label_id int, tag_field string, label string, aliases array<string>")
    df = spark.createDataFrame([(1, "f", "pillow case"), (2, "f", "pillow case"), (3, "f", "send mony"), (4, "f", "??"), (5, "f", None), (6, "f", "Send money")], "k long, tag_field string, tag_value string")
    assert {(r.tag_value, r.n) for r in canonical_list.unmatched(df, ref).collect()} == {("pillow case", 2), ("??", 1)}


# p5


def test_copies(spark):
    rows = [
        (5, "Ab Cd", "pair: A/B; entry: 35.51; stop: 2"), (4, "@ab_cd", '{"stop": "2", "pair": "a/b", "entry": "35.51"}'), (3, "ab cd", "stop - 2\nentry - 35.51\npair - A/B"), (2, "ab cd", "pair: A/B; entry: 3551; stop: 2"),
        (1, "ab cd", "pair: A/B; entry: 2; stop: 35.51"), (6, "ab cd", "The desk-sold 4.8, now!"), (7, "AB CD.", "the  desk sold 4.8 now"), (8, "ab cd", "The desk sold 48 now"), (9, "ab cd", "desk the sold 4.8 now"),
        (10, None, "x"), (11, "ab cd", None), (12, "ab cd", "  "), (13, "ab cd", "Straße"), (14, "ab cd", "STRASSE"), (15, "ab cd", "!!"), (16, "ab cd", "?"), (17, "ab cd", "y " * 50_000), (18, "ab cd", "Y " * 50_000),
    ]
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "k long, c string, m string, digest int, tree int, key int")
    assert {(r.kept_id, r.copy_id) for r in copies.copies(df, "k", ["c", "m"], required="m").collect()} == {(3, 4), (3, 5), (6, 7), (13, 14), (15, 16), (17, 18)}
    assert sum(r.n_copies for r in copies.posts(df, "k", ["c", "m"], required="m").collect()) == 15
    assert copies.copies(df.limit(0), "k", ["c", "m"]).count() == 0


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Entry: 35; Stop: 2", "Stop: 2; Entry: 35", True), ("Entry: 35; Stop: 2", "Entry: 2; Stop: 35", False), ("BTC signal\nEntry: 35\nStop: 2\nTarget: 40", "BTC signal\nTarget = 40\nEntry = 35\nStop = 2", True),
        ("BTC signal\nEntry: 35\nStop: 2", "ETH signal\nStop: 2\nEntry: 35", False), ("BTC signal: Entry: 35; Stop: 2", "BTC signal\nStop: 2\nEntry: 35", True), ("Entry: 35; Take profit: 5; Stop: 2", "Take profit - 5 | Stop - 2 | Entry - 35", True),
        ("Target: 40; Target: 45; Stop: 2", "Stop: 2; Target: 40; Target: 45", True), ("Target: 40; Target: 45; Stop: 2", "Stop: 2; Target: 45; Target: 40", False), ("Entry: 35\nStop: 2", '{"stop":"2","entry":"35"}', True),
        ("Stop: 2; Time: 10:30", "time: 10:30, stop: 2", True), ("Note: see: x; Stop: 2", "Stop: 2; Note: see: x", True), ("the desk: sold it, then; they: left", "the desk sold it then they left", True), ("they left then the desk sold it", "the desk sold it then they left", False),
    ],
)
def test_named_fields_in_any_order(spark, a, b, same):
    df = spark.createDataFrame([(1, "c", a), (2, "c", b)], "k long, c string, m string")
    assert {tuple(r) for r in copies.copies(df, "k", ["c", "m"]).collect()} == ({(1, 2)} if same else set())


def same_tree(a, b):
    return bool({copies.form(x) for x in copies.readings(a)} & {copies.form(x) for x in copies.readings(b)})


@pytest.mark.parametrize(
    "a, b, same",
    [
        ('{"id": "7", "a": {"b": "1", "c": "2"}}', '{"a": {"c": 2, "b": 1}, "id": 7}', True), ('{"id": "7", "a": {"b": "1", "c": "2"}}', '{"id": "7", "a": {"b": "1"}, "c": "2"}', False),
        ('{"id": 7, "a": [1, 2]}', '{"a": [1, 2], "id": 7}', True), ('{"id": 7, "a": [1, 2]}', '{"a": [2, 1], "id": 7}', False), ("id: 7; a: {b: 1; c: 2}", '{"A": {"C": "2", "B": "1"}, "ID": "7"}', True),
        ("id: 7; a: {b: 1; c: 2}", "a: {c: 2, b: 1}\nid = 7", True), ("id: 7; a: {b: 1}; c: 2", "id: 7; a: {b: 1; c: 2}", False), ('{"id": 7, "p": 35.50}', '{"p": "35.50", "id": "7"}', True),
    ],
)
def test_nested_records(spark, a, b, same):
    assert same_tree(a, b) is same
    for x in copies.readings(a):
        for y in copies.readings(b):
            assert (copies.digest(x) == copies.digest(y)) is (copies.form(x) == copies.form(y))
    df = spark.createDataFrame([(1, "c", a), (2, "c", b)], "k long, c string, m string")
    assert copies.copies(df, "k", ["c", "m"]).count() == int(same)


def test_equal_digests_are_compared(spark, monkeypatch):
    monkeypatch.setattr(copies, "root", lambda nodes: (b"x", "".join(map(copies.form, nodes)).encode()))
    df = spark.createDataFrame([(1, "c", "one"), (2, "c", "two"), (3, "c", "ONE")], "k long, c string, m string")
    rows = copies.trees(df, "k", ["c", "m"]).collect()
    assert {r.root for r in rows} == {b"x"}
    monkeypatch.setattr(copies, "trees", lambda *_: spark.createDataFrame([(r.key, r.root, r.form, r.others) for r in rows], "key long, root binary, form binary, others array<struct<root:binary,form:binary>>"))
    assert {tuple(r) for r in copies.copies(df, "k", ["c", "m"]).collect()} == {(1, 3)}


def test_posts_close_over_both_readings(spark):
    df = spark.createDataFrame([(4, "c", "A: x; B: y"), (3, "c", "b: y; a: x"), (2, "c", "b y a x"), (1, "c", "a x b y")], "k long, c string, m string")
    assert {tuple(r) for r in copies.copies(df, "k", ["c", "m"]).collect()} == {(1, 2), (1, 3), (1, 4)}
    assert [r.n_copies for r in copies.posts(df, "k", ["c", "m"]).collect()] == [4]


# p7


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("a", "b"), ("c", "c"), ("b", "d"), ("a", "b")]
    got = {r.node: r.root for r in related_splits.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["d"] == "a" and got["c"] == "c"


def test_subset_nearest():
    assert related_splits.subset_nearest([(7, 1), (5, 1), (11, 1)], 16) == [0, 1, 1]
    assert related_splits.subset_nearest([], 5) == [] and related_splits.subset_nearest([(9, 3)], 0) == [0]
    rnd = random.Random(4)
    for _ in range(200):
        sizes = [(rnd.randint(1, 30), rnd.randint(1, 4)) for _ in range(rnd.randint(1, 6))]
        target = rnd.randint(0, 120)
        sums = {0}
        for n, m in sizes:
            sums = {x + n * i for x in sums for i in range(m + 1)}
        taken = related_splits.subset_nearest(sizes, target)
        assert all(0 <= t <= m for t, (_, m) in zip(taken, sizes))
        assert abs(sum(t * n for t, (n, _) in zip(taken, sizes)) - target) == min(abs(x - target) for x in sums)


def test_deal_hits_the_totals_in_two_steps(monkeypatch):
    rnd = random.Random(5)
    heads = [(n, rnd.randint(0, n)) for n in (rnd.randint(2000, 90_000) for _ in range(40))]
    classes = [(n, p, rnd.randint(1, 60)) for n in range(1, 60) for p in {0, n // 2, n}]
    fixed = [(70_123, 30_000), (11_001, 5_000), (19_007, 9_000)]
    rows = sum(h[0] for h in heads) + sum(n * m for n, _, m in classes) + sum(f[0] for f in fixed)
    for limit in (10**9, 100_000):
        monkeypatch.setattr(related_splits, "BITSET_ROWS", limit)
        home, dealt = related_splits.deal(heads, classes, (0.7, 0.1, 0.2), fixed)
        assert all(sum(d) == m and min(d) >= 0 for d, (_, _, m) in zip(dealt, classes))
        for s, share in enumerate((0.7, 0.1, 0.2)):
            n, p = (fixed[s][at] + sum(h[at] for h, where in zip(heads, home) if where == s) + sum(c[at] * d[s] for c, d in zip(classes, dealt)) for at in (0, 1))
            assert abs(n - share * rows) <= 2, (limit, s)


def test_middling_components(spark, monkeypatch):
    monkeypatch.setattr(related_splits, "SMALL_ROWS", 3)
    monkeypatch.setattr(related_splits, "HEADS", 50)
    sizes = [1] * 300 + [2] * 80 + [5, 6, 7, 8, 9] * 30 + [200, 90]
    rows = [(f"d{i}", float(i % 2)) for i, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, d string, y double")
    out = related_splits.assign(df, "k", ["d"], "y")
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert out.count() == len(rows) and all(abs(n[s] - share * len(rows)) <= 1 for s, share in (("train", 0.7), ("val", 0.1), ("test", 0.2)))
    assert out.groupBy("component").agg(F.count_distinct("split").alias("s")).where("s > 1").count() == 0


def test_splits_come_from_components(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.0)], "k long, d string, y double")
    monkeypatch.setattr(related_splits, "components", lambda edges: edges.selectExpr("v as node", "'one' as root").distinct())
    assert {r.component for r in related_splits.assign(df, "k", ["d"], "y").collect()} == {"one"}


def test_assign(spark):
    rnd = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"d{rnd.randrange(200)}" if i % 7 else None, f"a{i}" if i % 50 else "link", rnd.choice([0.0, 1.0, None]), *JUNK) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, d string, a string, y double" + EXTRA)
    out = related_splits.assign(df, "k", ["d"], "y")
    assert out.count() == 3000 and out.groupBy("component").agg(F.count_distinct("split").alias("s")).where("s > 1").count() == 0
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(n["test"] - 600) <= 1 and abs(n["val"] - 300) <= 1
    two = related_splits.assign(df, "k", ["d", "a"], "y")
    assert two.join(df.where("a = 'link'").select("k"), "k").select("split").distinct().count() == 1
    assert related_splits.assign(df.limit(0), "k", ["d"], "y").count() == 0


# p8


def test_encoding(spark):
    texts = [None, "", " ", "a" * 3000, "  \n\n " * 500, "café it's <|endoftext|> 中文 \U0001f468‍\U0001f33e 12,5\n\nx " * 40, "word " * 900, "\x07‏"]
    df = spark.createDataFrame([(i, t, *JUNK[1:]) for i, t in enumerate(texts)], "id long, t string, rep string, n int, h int, label string, source int, class int")
    whole = {r.id: list(r.ids) for r in tokens.encode(df, "id", "t").collect()}
    cut = tokens.encode(df, "id", "t", chunk_chars=64, overlap_chars=16)
    assert {r.id: list(r.ids) for r in cut.collect()} == whole and whole[0] == [] and whole[1] == []
    assert {r.id: r.text for r in tokens.decode(cut, "id").collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert {r.id: r.n_tokens for r in tokens.encode(df, "id", "t", count_only=True, chunk_chars=64, overlap_chars=16).collect()} == {i: len(x) for i, x in whole.items()}
    assert tokens.encode(df.limit(0), "id", "t").count() == 0


# p9


def fill(spark, sources, total=None):
    df = spark.createDataFrame([(n, s, float(z * c)) for n, s, z, c in sources], "name string, share double, cap double")
    return {r.name: r.planned for r in mixture.filled(df, total).collect()}


def test_fill(spark):
    assert fill(spark, [("a", 0.5, 100, 1), ("b", 0.3, 1000, 2), ("c", 0.2, 0, 5)], 400) == {"a": 100.0, "b": 300.0, "c": 0.0}
    assert fill(spark, [("a", 0.5, 100, 1), ("b", 0.5, 1000, 2)]) == {"a": 100.0, "b": 100.0}
    assert fill(spark, []) == {} and fill(spark, [("a", 1.0, 10, 2)], 1e9) == {"a": 20.0}
    rnd = random.Random(3)
    sources = [(f"s{i}", rnd.random(), rnd.randint(0, 1000), rnd.randint(0, 4)) for i in range(60)]
    total = 0.6 * sum(z * c for _, s, z, c in sources)
    got = fill(spark, sources, total)
    open_ = [(got[n] / s) for n, s, z, c in sources if 0 < got[n] < z * c - 1e-9]
    assert abs(sum(got.values()) - total) < 1e-6 and max(open_) - min(open_) < 1e-9 and all(got[n] <= z * c for n, _, z, c in sources)
    assert all(z * c / s <= open_[0] + 1e-9 for n, s, z, c in sources if got[n] == z * c and z * c)


def test_mix(spark):
    docs = spark.createDataFrame([(i, "big" if i % 3 else "small", 1 + i % 9) for i in range(3000)] + [(9000, None, 5), (9001, "small", 0)], "k long, source string, z long")
    shares = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    got, report = mixture.mix(docs, shares, "k", "source", "z")
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].real_share - 5 / 9) < 0.002 and r["none"].real_share == 0 and r["small"].most_copies <= 3
    assert got.where("k >= 9000").count() == 0 and got.groupBy("k").count().where("count > 1").count() == 0
    assert mixture.mix(docs.limit(0), shares, "k", "source", "z")[0].count() == 0
