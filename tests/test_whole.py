"""Queries that once did less than the whole job."""

import random
import re
import unicodedata

import duckdb
import pandas as pd
import pytest

from lexiloom.functions.fuzzy import _token_score
from lexiloom.operators import catalog, shards
from lexiloom.plans import reference


def _tables(spark, lessons, recordings):
    """The two tables of the catalog's queries, of (id, level, title) and (lesson id, title)."""
    return spark.createDataFrame(lessons, "id string, level string, title string"), spark.createDataFrame(recordings, "lesson_id string, title string")


def _tokens(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c))
    t = re.findall("[a-z0-9]+", t.lower().replace("&", " and "))
    return t[: len(t) // 2] if len(t) % 2 == 0 and t[: len(t) // 2] == t[len(t) // 2 :] else t


def test_titles_in_any_characters_are_matched(spark):
    heard = ["Cafe Vepufaza", "Zoe of Kodu", "The Nino", "Ana's Cat", "Big Red Hill", "Angstrom Day"]
    odd = ["Caｆé Ｖepufaza", "Zoë of Kodu", "The Niño", "Ana’s\tCat", "Big Red\nHill", "Ångström Day", "Реtубоdu", "猫", None]
    tables = _tables(spark, [(f"L{i}", "A", t) for i, t in enumerate(odd)], [(f"X-A-{i}", t) for i, t in enumerate(heard)])
    words = lambda xs: {(i, " ".join(_tokens(t))) for i, t in enumerate(xs) if _tokens(t)}
    expected = {(f"L{i}/{x}", f"X-A-{j}/{y}") for i, x in words(odd) for j, y in words(heard) if 2 * len(set(x.split()) & set(y.split())) / len((x + " " + y).split()) >= 0.8}
    got = {(r.left_id, r.right_id) for r in catalog.title_pairs(*reference._titles(*tables)).collect()}
    assert {x[0].split("/")[0] for x in expected} == {"L0", "L1", "L2", "L3", "L4", "L5"} and got == expected


@pytest.mark.parametrize("piece", [7, 512])
def test_margins_by_all_three_measures(spark, piece):
    r = random.Random(7)
    words = "the cat dog of hill red big fish moon a pe pu meji".split()
    odd = ["where is pe pu meji", "where is pepumeji", "rabbit", "rabbits", "big dog", "the big dog of a red hill", "x" * 70 + " cat", "x" * 69 + "cat", "猫"]
    titles = lambda: [(f"{i:03}", r.choice("AB"), t) for i, t in enumerate([*odd, *(" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(50))])]
    left, right = titles(), [*titles(), *[(f"x{i}", "A", t) for i, t in enumerate(odd)], ("y", "C", "alone")]
    left += [(f"x{i}", "A", t) for i, t in enumerate(odd)]
    score = lambda a, b: float(_token_score.func(pd.Series([_tokens(a)]), pd.Series([_tokens(b)]))[0])
    all_ = {(i, j): score(a, b) for i, lv, a in left for j, lw, b in right if lv == lw}
    pairs = {k: s for k, s in all_.items() if s >= 0.6 - 1e-9}
    expected = {}
    for i in {i for i, _ in pairs}:
        mine = sorted((-s, j) for (x, j), s in pairs.items() if x == i)
        back = sorted((-s for (_, y), s in pairs.items() if y == mine[0][1]))
        seconds = [-mine[1][0] if len(mine) > 1 else 0.0, -back[1] if len(back) > 1 else 0.0]
        expected[i] = (mine[0][1], -mine[0][0], *seconds)
    frames = [spark.createDataFrame(t, "id string, level string, title string") for t in (left, right)]
    got = {m.left_id: (m.right_id, m.score, m.second, m.second_lesson) for m in catalog.margins(catalog.best_pairs(*frames, piece=piece)).collect()}
    assert got == expected
    assert {got[f"x{i}"][1] for i in (0, 1)} == {1.0} and got["x2"][1] == 1.0 and "y" not in got
    alone = [spark.createDataFrame([("1", "A", t)], "id string, level string, title string") for t in odd]
    reached = lambda i, j: [round(p.score, 2) for p in catalog.best_pairs(alone[i], alone[j]).collect()]
    assert reached(0, 1) == [1.0] and reached(2, 3) == [0.92] and reached(4, 5) == [0.93] and reached(2, 4) == [] == reached(8, 8)


def test_every_lesson_of_a_title_has_an_outcome(spark):
    lessons = [("L1", "A", "The Red Cat"), ("L2", "A", "the red, cat!"), ("L2", "A", "The Red Cat"), ("L3", "A", "The Red Cat"), ("L4", "A", "Moon and a Big Fish Hill"), ("L5", "A", "Moon and a big fish hill"), ("L6", "A", "One Dog"), ("L1", "B", "The Red Cat")]
    tables = _tables(spark, lessons, [("X-A-1", "The Red Cat"), ("X-A-2", "Moon & Big Fish Hill"), ("X-A-3", "One Dog"), ("X-A-4", "One Dog"), ("X-B-5", "The Red Cat")])
    members = {(r.side, r.block, r.id.split("/")[0], r.member.split("/")[0]) for r in reference.title_members(*tables).collect()}
    assert {m for m in members if m[0] == "left"} == {("left", b, o, m) for b, o, m in [("A", "L1", "L1"), ("A", "L1", "L2"), ("A", "L1", "L3"), ("A", "L4", "L4"), ("A", "L4", "L5"), ("A", "L6", "L6"), ("B", "L1", "L1")]}
    margin = {(r.block, r.left_id.split("/")[0]): round(r.margin, 3) for r in reference.two_ranked_margin(*tables).collect()}
    assert margin == {("A", "L1"): 0, ("A", "L2"): 0, ("A", "L3"): 0, ("A", "L4"): 0, ("A", "L5"): 0, ("A", "L6"): 0, ("B", "L1"): 1}
    used, low = "audio-already-used", "ambiguous-or-low-score"
    expected = {("A", "L1"): "mapped", ("A", "L2"): used, ("A", "L3"): used, ("A", "L4"): low, ("A", "L5"): low, ("A", "L6"): "mapped", ("B", "L1"): "mapped"}
    for f in (reference.greedy_assignment, reference.catalog_fuzzy):
        got = f(*tables).collect()
        assert {(r.block, r.left_id.split("/")[0]): r.outcome for r in got} == expected and len(got) == 7
        assert {r.right_id for r in got if r.left_id.startswith("L6")} == {"X-A-3/one dog"}


def test_import_checks_ids_and_sentences(spark):
    good = '[{"id": "s", "english": "A cat.", "chinese": ""}]'
    data = [(1, "a", "A", "T", good), (2, " ", "A", "T", good), (3, None, None, "", '{"sentences": ' + good + "}"), (4, "a", "A", "T", None), (5, "a", "A", "T", "[{"), (6, "a", "A", "T", "[]"), (7, "a", "A", "T", '{"x": 1}'), (8, "a", "A", "T", '[{"id": "s", "english": " "}]'), (9, "a", "A", "T", '[{"english": "A cat."}]')]
    lib = spark.createDataFrame(data, "row_id bigint, id string, level string, title string, sentences_json string")
    got = sorted((r.row_id, r.problem) for r in reference.import_violations(lib).collect())
    assert got == [(2, "id"), (3, "id"), (3, "level"), (3, "title"), *[(i, "sentences") for i in (4, 5, 6, 7)], (8, "english"), (9, "english")]
    course_library = pd.DataFrame(data, columns=lib.columns)  # noqa: F841
    assert sorted(duckdb.sql(reference.SQL["import_violations"]).fetchall()) == got


def test_shards_are_merged_over_official_results(spark):
    events = spark.createDataFrame([(4, "a", "error"), (8, "a", "view"), (1, "a", "view"), (5, "b", "error"), (2, "c", "error")], "event_id bigint, user_id string, event_type string")
    official, results = reference._shards(events)
    assert sorted(map(tuple, official.collect())) == [("a", "complete", 1), ("b", "failed", 5), ("c", "failed", 2)]
    merged = lambda r: sorted(map(tuple, shards.merged_results(official, r).collect()))
    assert merged(results) == [("a", "complete", 1), ("b", "failed", 5), ("c", "failed", 2)]
    assert merged(results.filter("shard = 0")) == [("a", "complete", 8), ("b", "failed", 5), ("c", "failed", 2)]
