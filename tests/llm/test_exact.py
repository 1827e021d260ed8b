"""Duplicates, leaks and repetition against plain loops; packing against its rules."""

import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import duplicates, leaks, packing, repetition
from lexiloom.llm.words import words

WORD = re.compile("[a-zà-öø-ÿ0-9]+")
LIB = "row_id bigint, id string, level string, title string, sentences_json string, source_name string, key string, first string, copies int"
DOC = "doc_id bigint, text string, item_id string, n int, w string"
ITEM = "item_id bigint, split_name string, text string, doc_id string"


def pairs(df):
    return sorted(map(tuple, df.collect()))


# duplicates


def test_duplicates(spark):
    titles = ["The Cat!", "the  cat", "THE-CAT", "The Café", "The Cafe", " ", "...", None, "The\tCat", "x" * 100_000, "X" * 100_000]
    rows = [(i, "i", lv, t, '{"b": 1, "a": [1]}' if i % 2 else '{"a":[1],"b":1}', "s", "k", "f", 1) for i, (t, lv) in enumerate((t, lv) for lv in ("A", "(a)", "B") for t in titles)]
    key = lambda x: "".join(c for c in x.lower() if not c.isspace() and unicodedata.category(c)[0] != "P")
    groups = defaultdict(list)
    for r in rows:
        if r[3] is not None:
            groups[key(r[2]), key(r[3])].append(r[0])
    df = spark.createDataFrame(rows, LIB).repartition(3)
    assert pairs(duplicates.pairs(df)) == sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    records = {r.row_id: (r.copies, r.contents) for r in duplicates.collapsed(df).collect()}
    assert records == {min(g): (len(g), 1) for g in groups.values()} | {r[0]: (1, 1) for r in rows if r[3] is None}
    assert duplicates.pairs(df.limit(0)).count() == 0 and duplicates.collapsed(df.limit(0)).count() == 0


def test_oversized_buckets_are_split(spark):
    rows = [(i, "i", "A", f"the well-known {i // 2:05}", None, None, None, None, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, LIB)
    key = duplicates.canonical("level", "title")
    got = duplicates.counted(df, key, "row_id", capacity=10).collect()
    assert len(got) == 1500 and all(r.copies == 2 for r in got)
    partial = df.select(key.alias("key"), df.row_id.alias("first")).mapInArrow(duplicates._combined, "key string, copies bigint, first bigint")
    assert max(duplicates.splits(partial, 10).values()) > 12


def test_hot_group(spark):
    rows = [(i, "i", "A", "Same!" if i % 3 else f"t{i}", None, None, None, None, 0) for i in range(9000)]
    got = duplicates.pairs(spark.createDataFrame(rows, LIB))
    assert got.count() == 5999 and {r[0] for r in got.collect()} == {1}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=20), st.integers(1, 5), st.integers(0, 99))))
def test_trie(entries):
    t, expected = duplicates.Trie(), {}
    for k, n, f in entries:
        t.add(k, n, f)
        a, b = expected.get(k, (0, 10**9))
        expected[k] = (a + n, min(b, f))
    assert {k: (a, b) for k, a, b in t} == expected


def test_member_order():
    assert duplicates.canonical_json('{"b":1, "a":{"d":2,"c":3}}') == '{"a":{"c":3,"d":2},"b":1}' and duplicates.canonical_json('["\\ud800"]').isascii() and duplicates.canonical_json("{") == "{"


# leaks


def test_leaks(spark):
    base = [f"w{i}" for i in range(40)]
    items = [(1, "dev", " ".join(base[:20]), "x"), (2, "test", " ".join(base[8:30]), "x"), (3, "dev", "short text only", "x"), (4, "dev", None, "x"), (5, "dev", "", "x")]
    docs = [
        (1, "Start. " + " ".join(base[:12]).upper() + "! End."), (2, " ".join(base[:11])), (3, " ".join(base)), (4, None), (5, ""), (6, " ".join(base[:6] + ["x"] + base[6:12])),
        (7, " ".join(base[5:9] * 3)), (8, "-".join(base[9:25])), (9, "猫 " * 50_000 + " ".join(base[:20])), (3, " ".join(base)),
    ]
    expected = set()
    for d, t in docs:
        own = WORD.findall(t.lower()) if t else []
        grams = {tuple(own[i : i + 12]) for i in range(len(own) - 11)}
        for i, _, x, _ in items:
            w = WORD.findall(x.lower()) if x else []
            if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                expected.add((d, i))
    D, E = spark.createDataFrame([(a, b, "c", 1, "c") for a, b in docs], DOC), spark.createDataFrame(items, ITEM)
    assert pairs(leaks.found(D, E)) == sorted(expected)
    spans = {(r.doc_id, r.item_id): (r.begin_char, r.end_char, r.n_words) for r in leaks.leaks(D, E).collect()}
    assert spans[1, 1] == (7, 7 + len(" ".join(base[:12])), 12) and spans[3, 1][2] == 20
    assert {r.item_id: r.n_documents for r in leaks.leaked_items(D, E).collect()} == {i: sum(x == i for _, x in expected) for i in range(1, 6)}
    clean = {r.doc_id: (r.text, r.dropped) for r in leaks.cleaned(D, E, drop_share=0.95).collect()}
    assert clean[1] == ("Start. ! End.", False) and clean[2] == (docs[1][1], False) and clean[4] == (None, False)
    assert leaks.found(D.limit(0), E).count() == 0 and leaks.found(D, E.limit(0)).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 10)
    items = [(i, "dev", " ".join(f"{i}w{k}" for k in range(12)), "x") for i in range(5)]
    docs = [(i, items[i][2], None, 0, None) for i in range(5)]
    assert pairs(leaks.found(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))) == [(i, i) for i in range(5)]


# repetition


def _slow(text, n):
    own, seen = words(text), set()
    cover = [False] * len(own)
    for i in range(len(own) - n + 1):
        g = tuple(own[i : i + n])
        if g in seen:
            cover[i : i + n] = [True] * n
        seen.add(g)
    return sum(cover), len(own)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40))
def test_repetition_against_a_loop(ws):
    m = repetition.measure(" ".join(ws))
    for k, n in enumerate(repetition.LENGTHS):
        assert m[1 + 2 * k] == _slow(" ".join(ws), n)[0]


def test_repetition(spark):
    texts = ["a b c d e f " * 2, "a b c d e f", None, "", "猫猫猫", "x " * 300_000, "one two three four five six " + "u v w " * 2 + "one two three four five six"]
    df = spark.createDataFrame([(i, t, None, 0, None) for i, t in enumerate(texts)], DOC)
    expected = [i for i, t in enumerate(texts) if t and _slow(t, 6)[1] and _slow(t, 6)[0] * 10 >= 3 * _slow(t, 6)[1]]
    assert sorted(r[0] for r in repetition.found(df).collect()) == expected
    s = {r.doc_id: r for r in repetition.shares(df).collect()}
    assert len(s) == len(texts) and s[2].n_words == 0 and s[2].share_6 == 0 and s[0].share_6 == 0.5
    assert repetition.measure("line\nother\nline\n\nline")[-1] == pytest.approx(8 / 17)
    assert repetition.found(df.limit(0)).count() == 0


# packing


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 50), st.lists(st.integers(1, 50), max_size=80), st.integers(1, 5))
def test_packer_keeps_to_its_capacity(capacity, sizes, windows):
    p, used = packing.Packer(capacity, windows), defaultdict(int)
    for s in sizes:
        if s <= capacity:
            used[p.add(s)] += s
            assert len(p.open) <= windows and p.open == sorted(p.open)
    assert all(u <= capacity for u in used.values())


def test_packing(spark):
    texts = ["word " * n for n in (1, 5, 700, 3, 30, 9000, 511, 512)] + [None, "", "猫" * 50, "a" * 5000]
    df = spark.createDataFrame([(i, t, None, 0, None) for i, t in enumerate(texts * 20)], DOC).repartition(5)
    goals = spark.createDataFrame([(1, "s", 512), (2, "l", 4096)], "target_id int, target_name string, capacity_tokens int")
    rows = packing.packed(df, goals).collect()
    enc = packing.encoder(packing.TOKENIZER)
    sizes = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts * 20)}
    for target, capacity in ((1, 512), (2, 4096)):
        own = [r for r in rows if r.target_id == target]
        used, parts = defaultdict(int), defaultdict(list)
        for r in own:
            parts[r.doc_id].append((r.token_start, r.n_tokens))
            if r.container_id:
                used[r.container_id] += r.n_tokens
            else:
                assert sizes[r.doc_id] == 0
        assert max(used.values()) <= capacity and set(parts) == set(sizes)
        for d, ps in parts.items():
            ps.sort()
            assert sum(n for _, n in ps) == sizes[d] and all(a + n == b for (a, n), (b, _) in zip(ps, ps[1:]))
            assert len(ps) == max(1, -(-sizes[d] // capacity))
        assert sum(used.values()) / (len(used) * capacity) > 0.9
    f = {r.target_id: r for r in packing.fill(df, goals).collect()}
    assert f[1].n_tokens == sum(sizes.values()) and f[1].most <= 512
    assert packing.packed(df.limit(0), goals).count() == 0 and packing.packed(df, goals.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, spark.createDataFrame([(1, "x", 0)], goals.schema))




def test_spans_lie_in_the_text_itself(spark):
    """Lower-casing may change a text's length; spans are those of the text, and nothing else goes."""
    a = " ".join(f"a{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"İİ wide İ start {a} end " + "word " * 40), (2, a), (3, None), (4, f"{a} " + "other " * 60)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "x", a), (2, "x", a[3:])], "item_id bigint, split_name string, text string")
    got = {r.doc_id: (r.text, r.removed_chars, r.dropped) for r in leaks.cleaned(docs, items).collect()}
    assert got[1] == ("İİ wide İ start  end " + "word " * 40, len(a), False) and got[2] == (None, len(a), True) and got[3] == (None, 0, False)
    assert got[4] == (" " + "other " * 60, len(a), False)


def test_blocks_of_items_are_taken_in_one_scan(spark, monkeypatch):
    a, b = (" ".join(f"{c}{i}" for i in range(14)) for c in "ab")
    docs = spark.createDataFrame([(1, f"{a} x {b}"), (2, b)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "x", a), (2, "x", b)], "item_id bigint, split_name string, text string")
    every = sorted(map(tuple, leaks.leaks(docs, items).collect()))
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 1)
    assert sorted(map(tuple, leaks.leaks(docs, items).collect())) == every and len(every) == 3


def test_splits_skip_what_all_keys_share(spark):
    keys = ["p" * 3000 + f"{i:04}" for i in range(60)] + ["p" * 3000] * 3
    partial = spark.createDataFrame([(k, 1, i) for i, k in enumerate(keys)], "key string, copies bigint, first bigint")
    assert len(duplicates.splits(partial, 8)) <= 12
    got = {r.key: r.copies for r in duplicates.counted(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int"), F.col("k"), "i", capacity=8).collect()}
    assert len(got) == 61 and got["p" * 3000] == 3
