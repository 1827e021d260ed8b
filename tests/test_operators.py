import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions.fuzzy import ratio
from lexiloom.operators import align, catalog, layout, learner, library, quality, ranking, shards, votes

rows = lambda df: sorted(map(tuple, df.collect()), key=repr)


# ranking


def test_numbering_hot_groups(spark):
    data = [("hot", i) for i in range(500)] + [("b", i) for i in range(7)] + [(None, 1), (None, 2)]
    random.Random(1).shuffle(data)
    n = ranking.numbered(spark.createDataFrame(data, "g string, v int").repartition(5), ["g"], ["v"], "n", "total")
    assert all(r.n == r.v + (0 if r.g is None else 1) and r.total == {"hot": 500, "b": 7}.get(r.g, 2) for r in n.collect()) and n.count() == 509
    s = ranking.running_sum(spark.createDataFrame(data, "g string, v int"), ["g"], ["v"], "v", "s")
    assert all(r.s == (sum(range(r.v + 1)) if r.g else sum(range(1, r.v + 1))) for r in s.collect())
    k = {(r.g, r.v): (r.previous_v, r.next_v) for r in ranking.neighbours(spark.createDataFrame(data, "g string, v int"), ["g"], ["v"], ["v"]).collect()}
    assert k["b", 0] == (None, 1) and k["b", 6] == (5, None) and k["hot", 250] == (249, 251) and k[None, 2] == (1, None)
    assert ranking.numbered(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0


@pytest.mark.parametrize("n, k", [(1, 5), (5, 5), (6, 5), (11, 5), (100, 8), (7, 2), (9, 1)])
def test_even_spacing(spark, n, k):
    df = spark.createDataFrame([("a", i) for i in range(n)], "g string, v int")
    expected = range(n) if n <= k else {0} if k == 1 else {round(i * (n - 1) / (k - 1)) for i in range(k)}
    assert sorted(r.v for r in ranking.evenly_spaced(df, ["g"], ["v"], k).collect()) == sorted(expected)


# library


def _lessons(spark, data):
    return spark.createDataFrame([(i, *x[:3], None, x[3], x[4]) for i, x in enumerate(data)], f"row_id bigint, id string, level string, title string, title_zh string, sentences {library.SENTENCES}, source_name string")


def test_library(spark):
    s = lambda *ts: [("x", t, None) for t in ts]
    data = [
        ("L-2", "a", "Two", s("Hi.", " ", "Yo."), "p"), ("L-1", "A", "One", s("No mark"), "p"), ("L-1", "A", "One", s("Hi."), "q"), ("L-2", "a", "Two b", s("Hi.", "", "Yo!"), "p"),
        ("Z", "?", "Bad", s("x"), None), ("none", "A", "None", None, None),
    ]
    out = {r.id: r for r in library.built(_lessons(spark, data)).collect()}
    assert [(k, out[k].source_lesson_id, out[k].title) for k in sorted(out)] == [("RAZ-A-001", "L-1", "One"), ("RAZ-A-002", "L-1", "One"), ("RAZ-A-003", "L-2", "Two b"), ("RAZ-A-004", "none", "None")]
    assert out["RAZ-A-001"].source_id_duplicated and not out["RAZ-A-003"].source_id_duplicated
    assert [x.id for x in out["RAZ-A-003"].sentences] == ["RAZ-A-003-S001", "RAZ-A-003-S003"] and out["RAZ-A-003"].status == "pass"
    assert out["RAZ-A-001"].reasons == ["missing_terminal_punctuation"] and out["RAZ-A-004"].reasons == ["no_sentences"]
    assert library.duplicate_ids(library.built(_lessons(spark, data))).count() == 0
    order = spark.createDataFrame([("A:twob", 1)], "order_key string, position int")
    assert {r.id for r in library.built(_lessons(spark, data), order).filter("title = 'Two b'").collect()} == {"RAZ-A-001"}
    assert library.built(_lessons(spark, [])).count() == 0


def test_corrections_are_idempotent(spark):
    data = [("a", "A", "T", [("1", "old", None), ("2", "x", None)], "p"), ("b", "B", "T", [("1", "old", None), ("2", "old", None)], "p"), ("c", "C", "T", [("1", "y", None)], "p"), ("d", "D", "T", [("1", "old", None)], "p")]
    fixes = spark.createDataFrame([(lv, "T", "old", ["n1", "n2"]) for lv in "ABC"], "level string, title string, replace string, with array<string>")
    once = library.corrected(_lessons(spark, data), fixes)
    got = {r.id: (r.correction, [s.english for s in r.sentences]) for r in once.collect()}
    assert got == {"a": ("applied", ["n1", "n2", "x"]), "b": ("ambiguous", ["old", "old"]), "c": ("missing", ["y"]), "d": ("none", ["old"])}
    twice = {r.id: (r.correction, [s.english for s in r.sentences]) for r in library.corrected(once.drop("correction"), fixes).collect()}
    assert twice["a"] == ("already", ["n1", "n2", "x"])


def test_violations(spark):
    data = [("a", "A", "T", [("1", "x", None)], "p"), (" ", "A", None, [("1", " ", None)], "p"), ("c", "A", "T", [], "p")]
    assert rows(library.violations(_lessons(spark, data))) == [(" ", "english"), (" ", "id"), (" ", "title"), ("c", "sentences")]
    assert rows(library.violations(_lessons(spark, data[:1]), most=0)) == [(None, "lesson count")]


def test_trim(one):
    f = lambda s: library.trimmed(s, F.lit(9))
    body = ["one two three four."] * 3
    assert one(f, [*body, "Try This at home now."], kinds=["array<string>"]) == body
    assert one(f, ["Try This now."] + body, kinds=["array<string>"]) == ["Try This now.", *body]


# catalog


def test_candidates_lose_nothing(spark):
    r = random.Random(4)
    words = "the cat dog of hill red big fish moon a".split()
    titles = lambda n: [(f"{i:03}", r.choice("AB"), " ".join(r.choices(words, k=r.randint(1, 5)))) for i in range(n)]
    left, right = titles(60), titles(60)
    got = {(x.left_id, x.right_id) for x in catalog.title_pairs(*[spark.createDataFrame(t, "id string, level string, title string") for t in (left, right)]).collect()}
    from collections import Counter

    def tokens(t):
        t = t.split()
        return t[: len(t) // 2] if len(t) % 2 == 0 and t[: len(t) // 2] == t[len(t) // 2 :] else t

    expected = set()
    for i, lv, a in left:
        for j, lw, b in right:
            x, y = tokens(a), tokens(b)
            if lv == lw and 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y)) >= 0.8:
                expected.add((i, j))
    assert got == expected


def test_assignment_is_one_to_one(spark):
    data = [("L1", "R1", 0.95, 0.1), ("L2", "R1", 0.9, 0.2), ("L3", "R2", 0.85, 0.01), ("L4", "R3", 1.0, 0.0), ("L5", "R2", 0.84, 0.05), ("L6", "R4", 0.9, 0.5), ("L7", "R5", 0.99, 0.5)]
    best = spark.createDataFrame([("A", *x) for x in data], "block string, left_id string, right_id string, score double, margin double")
    got = {r.left_id: r.outcome for r in catalog.assigned(best).collect()}
    assert got == {"L1": "mapped", "L2": "audio-already-used", "L3": "ambiguous-or-low-score", "L4": "mapped", "L5": "mapped", "L6": "mapped", "L7": "mapped"}
    over = spark.createDataFrame([("L6", None), ("L1", "R5")], "left_id string, right_id string")
    got = {r.left_id: (r.outcome, r.right_id) for r in catalog.assigned(best, over).collect()}
    assert got["L6"] == ("disabled", None) and got["L1"] == ("override", "R5") and got["L7"][0] == "audio-already-used" and got["L2"][0] == "mapped"


# alignment


def _slow(expected, actual, p):
    """Least cost by the plain recurrence."""
    n, m = len(expected), len(actual)
    c = np.full((n + 1, m + 1), 1e9)
    c[0] = 0
    for i in range(1, n + 1):
        c[i, 0] = i
        for j in range(1, m + 1):
            s = ratio(expected[i - 1], actual[j - 1])
            sub = (1.15 if s < 0.5 else (1 - s) * 1.25) + (1 - p[j - 1]) * 0.04
            c[i, j] = min(c[i - 1, j - 1] + sub, c[i, j - 1] + 0.82, c[i - 1, j] + 1)
    return c


@pytest.mark.parametrize("seed", range(25))
def test_alignment_costs_least(seed):
    r = random.Random(seed)
    words = ["cat", "cats", "dog", "the", "a", "hill", "hills"]
    expected, actual = r.choices(words, k=r.randint(1, 8)), r.choices(words, k=r.randint(0, 12))
    p = [round(r.random(), 2) for _ in actual]
    found = align.align_words(expected, actual, p)
    if not actual:
        assert found == {}
        return
    c = _slow(expected, actual, p)
    # the cost of what was found: matches as they are, other words left out on one side or taken for one another
    pairs = sorted(found.items())
    assert all(a < b and x < y for (a, x), (b, y) in zip(pairs, pairs[1:])) and all(ratio(expected[i], actual[j]) >= 0.5 for i, j in pairs)
    exact = [i for i, j in pairs if expected[i] == actual[j]]
    if c[-1].min() < 0.04 * len(expected):
        assert len(exact) == len(expected)


def test_alignment_golden():
    assert align.align_words("the cat sat".split(), "title the cat um sat end".split(), [1.0] * 6) == {0: 1, 1: 2, 2: 4}
    assert align.align_words(["zzz"], ["aaa"], [1.0]) == {}
    assert align.align_words([], ["a"], [1.0]) == {} and align.align_words(["a"], [], []) == {}


def test_anchors_and_ranges(spark):
    e = spark.createDataFrame([("k", 0, ["the", "cat"]), ("k", 1, ["sat"]), ("k", 2, ["nothing"]), ("none", 0, ["x"])], "key string, pos int, words array<string>")
    a = spark.createDataFrame([("k", ["the", "cat", "sat"], [1.0, 1.4, 2.0], [1.3, 1.8, 2.4], [1.0, 0.5, 1.0])], "key string, words array<string>, starts array<double>, ends array<double>, probabilities array<double>")
    found = align.anchors(e, a)
    got = {(r.key, r.pos): (r.matched, r.first, r.last, r.probability) for r in found.collect()}
    assert got == {("k", 0): (2, 1.0, 1.8, 0.75), ("k", 1): (1, 2.0, 2.4, 1.0), ("k", 2): (0, None, None, 0.0), ("none", 0): (0, None, None, 0.0)}
    assert rows(align.unanchored(found)) == [("k", 3, [2], False), ("none", 1, [0], False)]
    quiet = spark.createDataFrame([("k", 0.7, 1.0), ("k", 0.8, 0.9), ("k", 2.5, 2.9)], "key string, s_start double, s_end double")
    r = {x.pos: (x.start, x.end) for x in align.without_overlaps(align.snapped(found, quiet)).collect()}
    assert r == {0: (0.85, 1.9), 1: (1.9, 2.7)}


# quality


def test_gate_edges(spark):
    clip = lambda k, m, c, d: (k, 10, m, c, d)
    data = [clip("pass", 9, 0.9, 0.45), clip("pass", 9, 0.9, 90.0), clip("low", 8, 0.9, 1.0), clip("weak", 10, 0.1, 1.0), clip("short", 10, 0.9, 0.44)]
    g = {r.key: r.passed for r in quality.quality_gate(spark.createDataFrame(data, "key string, expected int, matched int, confidence double, duration double")).collect()}
    assert g == {"pass": True, "low": False, "weak": False, "short": False}


def test_sample_has_ends_and_weakest(spark):
    df = spark.createDataFrame([("k", i, 1.0 - (i in (3, 5)) * 0.5) for i in range(20)], "key string, pos int, confidence double")
    got = {r.pos for r in quality.sampled(df, 4).collect()}
    assert got == {0, 6, 13, 19, 3, 5}


def test_contamination(spark):
    df = spark.createDataFrame([("k", 0, 0.8, None, 0.9), ("k", 1, 0.8, 0.88, 0.1)], "key string, pos int, score double, previous_score double, next_score double")
    assert [r.passed for r in quality.contaminated(df).orderBy("pos").collect()] == [False, True]


# shards


def test_shard_merge_keeps_failures(spark):
    results = spark.createDataFrame([("L1", "failed", 1), ("L1", "complete", 2), ("L2", "complete", 1)], "lesson_id string, status string, shard int")
    official = spark.createDataFrame([("s1", "o"), ("s2", "o"), ("s3", "o")], "sentence_id string, url string")
    sentences = spark.createDataFrame([("L1", "s1"), ("L1", "s2"), ("L2", "s3")], "lesson_id string, sentence_id string")
    index = spark.createDataFrame([("s2", "n", 1), ("s2", "m", 0), ("s4", "n", 2)], "sentence_id string, url string, shard int")
    merged = shards.merged_index(official, index, results, sentences)
    assert rows(merged) == [("s2", "n"), ("s3", "o"), ("s4", "n")] == rows(shards.merged_index(merged, index, results, sentences))
    assert rows(shards.merged_results(results.drop("shard").limit(0), results)) == [("L1", "complete"), ("L2", "complete")]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([(None, 3), ("b", 4), ("b", 5)], "k string, v int")
    assert rows(shards.upserted(old, new, ["k"], ["v"])) == [("a", 1, "x"), ("b", 5, None), (None, 3, None)]
    assert rows(shards.zip_mismatches(old.select("k", "v"), new.limit(1), ["k"], "v")) != []


# learners


def test_outcomes(spark):
    data = [("w1", i, r) for i, r in enumerate([False, False, True, False])] + [("w2", i, r) for i, r in enumerate([False, False, False, True])] + [("w3", 0, False)]
    got = rows(learner.outcomes(spark.createDataFrame(data, "word string, n int, right boolean"), ["word"], ["n"]))
    assert got == [("w1", 2, "correct"), ("w2", 3, "revealed"), ("w3", 1, "wrong")]


def test_streaks(spark):
    days = spark.createDataFrame([("a", d) for d in ("2024-02-28", "2024-02-29", "2024-03-01", "2024-03-01", "2024-03-03")] + [("b", "2024-02-01")], "user_id string, d string").select("user_id", F.to_date("d").alias("day"))
    assert rows(learner.streak(days, F.lit("2024-03-01").cast("date"))) == [("a", 3), ("b", 0)]
    assert sorted(r.length for r in learner.runs(days).collect()) == [1, 1, 3]


def test_states(spark):
    df = spark.createDataFrame([(1, "u", '{"vocabulary": null, "selectedLevel": "??"}', "t"), (2, "u", "{", "t"), (3, "u", None, "t")], "row_id bigint, user_id string, state_json string, updated_at string")
    assert [(r.row_id, r.vocabulary, r.progress, r.total_sentences, r.level) for r in learner.states(df).collect()] == [(1, [], {}, 0, "A")]


# layout and votes


def test_modes_and_markers(spark, one):
    w = spark.createDataFrame([("d", 1, "Title", 20.0, False), ("d", 2, "word", 12.04, True), ("d", 3, "wd", 11.0, True), ("e", 1, "x1", 9.0, False), ("f", 1, "..", 12.0, True)], "doc string, seq int, text string, size double, ends_sentence boolean")
    assert rows(layout.dominant_size(w)) == [("d", 12.0, 4), ("e", 9.0, 2)]
    mark = lambda *ls: one(layout.page_marker, list(ls), kinds=["array<string>"])
    assert mark("Table of Contents") == "skip" and mark("Glossary") == "stop" and mark("A cat.") is None and mark("a...", "b...", "c...") == "skip" and mark("Photo Credits") == "stop"


def test_subset_sum():
    assert layout.chosen_blocks(100, [(60, 0), (40, 0), (100, 4)]) == [0, 1]
    assert layout.chosen_blocks(10, [(500, 0)]) == []
    from itertools import combinations

    r = random.Random(2)
    for _ in range(30):
        gap, blocks = r.randint(20, 200), [(r.randint(1, 90), r.choice([0, 1, 4, 8])) for _ in range(6)]
        cost = lambda c: abs(gap - sum(blocks[i][0] for i in c)) * 10 + sum(blocks[i][1] for i in c)  # noqa: B023, E731
        best = min(cost(c) for n in range(7) for c in combinations(range(6), n))
        assert cost(layout.chosen_blocks(gap, blocks)) == best


def test_cover(one):
    lines = ["Visit us", "The Big", "Red Barn", "A Reading A–Z Level D Book"]
    f = lambda s, t: layout.cover_title(s, t)
    assert one(f, lines, "File", kinds=["array<string>", "string"]) == "The Big Red Barn"
    assert one(f, ["x"], "File Name", kinds=["array<string>", "string"]) == "File Name"


def test_votes(spark):
    df = spark.createDataFrame([(1, "A cat ran.", "A cat ran."), (2, "A cat ran.", "zzzz qqqq"), (3, None, "Only."), (4, "Only.", None), (5, None, None)], "id int, vision string, unlimited string")
    got = {r.id: (r.used, r.selected, r.similarity) for r in votes.two_way(df).collect()}
    assert got[1] == ("unlimited_ocr", "A cat ran.", 1.0) and got[2][0] == "vision_fallback" and got[3][:2] == ("unlimited_ocr", "Only.") and got[4][:2] == ("vision_fallback", "Only.") and got[5][:2] == ("vision_fallback", "")
    sheet = spark.createDataFrame([(1, "text [0,50,100,100] Second\ntext [600,0,900,100] Other\ntext [0,5,100,90] First\nimage [0,0,9,9] no")], "id int, raw string")
    assert rows(votes.sheet_texts(sheet)) == [(1, 0, "First Second"), (1, 1, "Other")]


def test_body_pages(spark):
    def page(p, lines, size=12.0, font="X+Body-Roman", top=50.0):
        return [("d", p, 100 * p + 10 * i + k, w, 10.0 + 40 * k, 45.0 + 40 * k, top + 14 * i, top + 14 * i + 10, size, font, 600.0, 800.0, line.endswith(".")) for i, line in enumerate(lines) for k, w in enumerate(line.split())]

    data = page(1, ["Table of Contents"], 12.0) + page(2, ["A cat ran up.", "It sat there."]) + page(2, ["CAPTION"], 20.0, "Y+Head-Bold", 300.0) + page(2, ["foot note."], top=760.0) + page(3, ["12", "The end came."]) + page(4, ["Glossary"]) + page(5, ["More words."])
    words = spark.createDataFrame(data, "doc string, page int, seq int, text string, x0 double, x1 double, top double, bottom double, size double, font string, width double, height double, ends_sentence boolean")
    got = {r.page: (r.status, r.text) for r in layout.body_pages(words).collect()}
    assert got == {1: ("skip", None), 2: ("body", "A cat ran up. It sat there."), 3: ("body", "The end came."), 4: ("stop", None), 5: ("after_back_matter", None)}


def test_scan_lessons(spark):
    rows_ = [
        ("a", 1, None, None, "", "cover"), ("a", 2, "The Cat", 1, "one", "x"), ("a", 3, None, 3, "two", "x"), ("a", 4, None, None, "ends.", "x"), ("a", 5, None, None, "no mark", "x"), ("a", 6, "The Cat!", 5, "three", "x"),
        ("a", 7, "A Dog", 1, "four", "x"), ("a", 8, None, None, "b.", "All rights reserved"), ("a", 9, None, 7, "lost", "x"), ("b", 1, None, 4, "lost", "x"), ("b", 2, "A Dog", 1, "five", "x"),
    ]
    df = spark.createDataFrame(rows_, "source string, page int, title string, number int, body string, raw string")
    assert sorted((r.source, r.page, r.lesson, r.title) for r in layout.scan_lessons(df).collect()) == [("a", 2, 1, "The Cat"), ("a", 3, 1, "The Cat"), ("a", 4, 1, "The Cat"), ("a", 6, 1, "The Cat"), ("a", 7, 2, "A Dog"), ("b", 2, 1, "A Dog")]


def test_selection(spark):
    from lexiloom.operators import selection as S

    df = spark.createDataFrame([("a", "A", 0.9), ("b", "B", 0.5), ("c", "A", 0.7)], "id string, level string, score double")
    assert [r.id for r in S.chosen(df, 0.8, level=["A"], id=[]).collect()] == ["a"] and S.chosen(df).count() == 3
    assert S.the_one(df, F.col("id") == "b").first().level == "B"
    with pytest.raises(LookupError):
        S.the_one(df, F.col("level") == "A")
    assert [r.id for r in S.in_order_of(df, "id", ["c", "a"]).collect()] == ["c", "a", "b"]
    assert [tuple(r) for r in S.by_frequency(df, "level", "id").collect()] == [("A", 2), ("B", 1)]
    e = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "lesson_id string, name string")
    f = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), ("y", "9")], "lesson_id string, name string")
    assert rows(S.complete(e, f)) == [("x", True), ("y", False)]
    assert S.best_by_score(df, (F.col("level") == "A", 2), (F.col("score") < 0.8, 1)).first().id == "c"


# plans that spread hot groups


def test_neighbours_and_last_seen_by_brute_force(spark):
    r = random.Random(4)
    data = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice([None, str(i)])) for i in range(400)]
    df = spark.createDataFrame(data, "g string, i int, v string").repartition(7)
    by = {g: sorted(x for x in data if x[0] == g) if g else sorted((x for x in data if x[0] is None), key=lambda x: x[1]) for g in {x[0] for x in data}}
    near = {(x.g, x.i): (x.previous_i, x.next_i, x.previous_v) for x in ranking.neighbours(df, ["g"], ["i"], ["i", "v"]).collect()}
    seen = {(x.g, x.i): x.s for x in ranking.last_seen(df, ["g"], ["i"], "v", "s").collect()}
    assert len(near) == len(seen) == 400
    for g, rows_ in by.items():
        last = None
        for k, (_, i, v) in enumerate(rows_):
            last = v if v is not None else last
            before, after = rows_[k - 1] if k else (None, None, None), rows_[k + 1] if k + 1 < len(rows_) else (None, None, None)
            assert near[g, i] == (before[1], after[1], before[2]) and seen[g, i] == last
    assert ranking.neighbours(df.limit(0), ["g"], ["i"], ["i"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_silences_by_brute_force(spark, seed):
    r = random.Random(seed)
    anchors = [("k", i, round(r.uniform(0, 60), 2)) for i in range(80)]
    found = spark.createDataFrame([(k, i, a, a + 1.3) for k, i, a in anchors] + [("none", 0, 5.0, 6.0)], "key string, pos int, first double, last double")
    gaps = [(s, round(s + r.uniform(0.1, 0.8), 2)) for s in (round(r.uniform(0, 62), 2) for _ in range(120))]
    silences = spark.createDataFrame([("k", a, b) for a, b in gaps], "key string, s_start double, s_end double")
    got = {(x.key, x.pos): (round(x.start, 6), round(x.end, 6)) for x in align.snapped(found, silences).collect()}
    long = [(a, b, (a + b) / 2) for a, b in gaps if b - a >= align.SILENCE]
    for k, i, f in anchors:
        last = f + 1.3
        start = max((m for a, b, m in long if b <= f + align.SLACK and f - m <= align.SNAP), default=f - align.LEAD_IN)
        end = min((m for a, b, m in long if a >= last - align.SLACK and m - last <= align.SNAP), default=last + align.LEAD_OUT)
        assert got[k, i] == (round(max(0, start), 6), round(end, 6))
    assert got["none", 0] == (4.82, 6.25)
    near = {x.pos: round(x.mid, 6) for x in align.nearest(found.selectExpr("key", "pos", "first as t"), silences, window=1.0).collect()}
    for _, i, f in anchors:
        best = min((abs(m - f), m) for *_, m in long)
        assert near.get(i) == (round(best[1], 6) if best[0] <= 1.0 else None)


@pytest.mark.parametrize("seed", range(20))
def test_blocks_by_brute_force(seed):
    r = random.Random(seed)
    blocks = [(r.randint(1, 60), r.choice([0, 1, 4, 8])) for _ in range(r.randint(0, 9))]
    gap = r.randint(1, 150)
    most = max(gap + 250, round(gap * 1.5))
    cost = lambda chosen: (abs(gap - sum(blocks[i][0] for i in chosen)) * 10 + sum(blocks[i][1] for i in chosen), sum(blocks[i][1] for i in chosen))
    every = [[i for i in range(len(blocks)) if m >> i & 1] for m in range(1 << len(blocks))]
    best = min(cost(c) for c in every if sum(blocks[i][0] for i in c) <= most)
    assert cost(layout.chosen_blocks(gap, blocks)) == best


def test_a_second_extraction_is_kept_only_if_it_is_better(spark):
    word = lambda d, p, i, font, size=12.0: (d, p, p * 1000 + i, f"w{i}x", size, f"A+{font}-Roman", True)
    data = [word("a", p, i, "Body") for p in (1, 2) for i in range(45)] + [word("a", 2, 100 + i, "Other") for i in range(40)] + [word("b", 1, i, "Body") for i in range(80)] + [word("b", 1, 100 + i, "Other") for i in range(90)]
    words = spark.createDataFrame(data, "doc string, page int, seq int, text string, size double, font string, ends_sentence boolean")
    expected = spark.createDataFrame([("a", 128), ("b", 85)], "doc string, expected int")
    got = {r.doc: (r.before, r.after, r.blocks) for r in layout.completed(words, expected).collect()}
    assert got == {"a": (90, 130, 1), "b": (90, 90, 0)}


def test_strict_and_refined(spark):
    h = spark.createDataFrame([("A cat!", "a CAT"), ("A cat", "a cap"), ("", ""), (None, "x")], "expected string, heard string")
    assert [(r.exact, r.passed) for r in quality.strict(h).collect()] == [(True, True), (False, False), (True, False), (False, False)]
    w = spark.createDataFrame([(i, 10.0 * i, 0.5, 1.0, 10.0 * i, 10.0 * i + 1) for i in range(4)], "id int, base double, start double, end double, coarse_start double, coarse_end double")
    risky = w.filter("id > 0").select("id")
    done = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, False)], "id int, source_start double, source_end double, drift_start double, drift_end double, fresh boolean")
    once = align.refined(w, risky, done, "base")
    assert {(r.id, r.source_start, r.fresh) for r in once.collect()} == {(1, 0.0, False), (2, 20.5, True), (3, 30.5, True)}
    assert align.refined(w, risky, once.withColumn("fresh", F.lit(False)), "base").filter("fresh").count() == 0
