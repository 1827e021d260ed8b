import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.operators import nested

LIB, STATE = "row_id bigint, sentences_json string, k string, v string, path string", "row_id bigint, state_json string, label int"


def test_tables_and_parents(spark):
    doc = [
        {"id": "a", "english": "Hi.", "chinese": None, "audio": {"audioUrl": "u", "duration": 1.5, "words": [{"text": "Hi", "start": 0, "end": 0.5}, None, {"text": "!", "probability": 0.5}]}},
        None,
        {"id": "b", "english": "", "notes": [{"kind": "k", "text": "t", "reviewers": [None, {"role": "r", "accepted": True}]}], "audio": {}},
    ]
    rows = [(1, json.dumps(doc), "x", "y", "z"), (2, json.dumps({"sentences": doc}), None, None, None), (3, json.dumps(doc)[:-3], None, None, None), (4, "", None, None, None), (5, None, None, None, None), (6, "[NaN]", None, None, None), (7, "{} x", None, None, None)]
    n = nested.lesson_nodes(spark.createDataFrame(rows, LIB))
    words = {(r.row_id, r.item): r for r in nested.child_table(n, "word").collect()}
    assert set(words) == {(i, x) for i in (1, 2) for x in ("0/0", "0/2")} and words[1, "0/2"].parent_item == "0" and words[1, "0/2"].probability == 0.5 and words[1, "0/0"].end == 0.5
    s = {(r.row_id, r.item): r for r in nested.child_table(n, "sentence").collect()}
    assert set(s) == {(i, x) for i in (1, 2) for x in ("0", "2")} and s[1, "0"].audio_url == "u" and s[1, "0"].chinese is None and s[1, "0"].parent_item is None
    assert [(r.item, r.parent_item, r.accepted) for r in nested.child_table(n, "reviewer").filter("row_id = 1").collect()] == [("2/0/1", "2/0", True)]


def test_records_of_states(spark):
    doc = {"vocabulary": [{"word": "w", "addedAt": 5}, None], "progress": {"RAZ-A-001": {"completed": 1, "total": 2}, "x": None}, "studyDays": ["2025-1-2", None, "2025-1-3"], "game": {"bestFloor": 1}}
    states = spark.createDataFrame([(9, json.dumps(doc), 1), (10, '{"progress": null}', 2)], STATE)
    got = {tuple(r) for r in nested.records(spark.createDataFrame([], LIB), states).collect()}
    assert got == {("vocabulary", 9, "0"), ("progress", 9, "RAZ-A-001"), ("study_day", 9, "0"), ("study_day", 9, "2")}


def test_empty_tables(spark):
    assert nested.records(spark.createDataFrame([], LIB), spark.createDataFrame([], STATE)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=20))
def test_every_parent_is_there(doc):
    rows = nested.shred(json.dumps(doc), "root", frozenset())
    labels = {(r[1]) for r in rows}
    for path, label, _, _ in rows:
        if len(label) > 1:
            assert label[:-1] in labels or "[]" in path


def test_half_surrogates(spark):
    doc = '[{"english": "a\\ud800b", "\\udc00": 1, "audio": {"words": [{"text": "\\ud83d\\ude00"}]}}]'
    n = nested.lesson_nodes(spark.createDataFrame([(1, doc, None, None, None)], LIB))
    assert nested.child_table(n, "sentence").first().english == "a\ufffdb" and nested.child_table(n, "word").first().text == "😀"


def test_deep_documents_dont_break_it():
    assert nested.shred("[" * 200_000 + "]" * 200_000, "r", frozenset(), frozenset(["r"])) == [("r", (0,), None, [])]
    wide = json.dumps([{"english": "x"}] * 50_000)
    assert len(nested.shred(wide, "r", frozenset())) == 50_000


def test_documents_of_any_depth():
    from lexiloom.functions.jsontext import _deep, loads

    n = 20_000
    lists = '{"sentences": [{"english": "a", "x": ' + "[" * n + "]" * n + "}]}"
    objects = '[{"english": "b", "x": ' + '{"k": ' * n + "1" + "}" * n + "}]"
    for text, english in ((lists, "a"), (objects, "b")):
        got = nested.shred(text, "sentences", frozenset(), frozenset(["sentences"]))
        assert [(r[0], r[1], dict(r[3])["english"]) for r in got] == [("sentences", (0,), english)]
    for text in ('[1, -2.5e3, "a\\u00e9\\n", true, false, null, [], {}, {"a": {"b": [1]}, "c": ""}]', " {} ", "3"):
        assert _deep(text) == loads(text)
    for bad in ("", "[1,]", "[1", '{"a" 1}', "{1: 2}", "[] x", "[NaN]", "[01]", '{"a": 1,}', "nul"):
        with pytest.raises(ValueError):
            _deep(bad)


def test_wanted_paths_give_the_same_records():
    text = '{"sentences": [{"english": "a", "audio": {"words": [{"text": "a"}, null]}, "notes": [{"kind": "k", "reviewers": [{"role": "r"}]}]}, [[1]]]}'
    every = nested.shred(text, "sentences", frozenset())
    for path in nested.LESSON_TABLES.values():
        assert nested.shred(text, "sentences", frozenset(), frozenset([path])) == [r for r in every if r[0] == path]
