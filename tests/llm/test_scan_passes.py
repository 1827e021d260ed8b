"""How often the pages of problem 2 are read, and that what is read once gives the same as before."""

import unicodedata
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame

from lexiloom.llm import scans

OCR = "page_id bigint, lesson_id string, page int, title string, vision string, unlimited string"
REC = "page_id bigint, lesson_id string, physical_page int, side string, text string"
LIB = "row_id bigint, id string, title string"


def _tables(spark, rows):
    return spark.createDataFrame(rows, OCR), spark.createDataFrame([], REC), spark.createDataFrame([], LIB)


def test_python_gets_the_pages_four_times(spark, monkeypatch):
    """Edges, words, neighbours and questions, judgement; the ends of pages come with the questions."""
    passes, own = [], DataFrame.mapInArrow

    def counted(df, f, *args, **more):
        passes.extend([f.__qualname__] * ("a" in df.columns))
        return own(df, f, *args, **more)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    assert {(r.line_no, r.kind) for r in scans.found(*_tables(spark, [(1, "B", 1, None, "the old rab-\nbit ran", None)])).collect()} == {(1, "hyphen")}
    assert len(passes) == 4


def test_a_page_is_put_together_once_and_asks_in_one_row(monkeypatch):
    calls, own = [], scans.tokens
    monkeypatch.setattr(scans, "tokens", lambda *x: calls.append(x) or own(*x))
    shared = SimpleNamespace(value=scans.Shared(np.zeros(0, np.uint64)))
    texts = ["an old-\nfashioned rab-\nbit ran a-", "the cat"]
    one = {"kind": ["ocr"] * 2, "page_id": [1, 2], "book": ["B"] * 2, "place": [2, 4], "a": texts, "b": [None, "the rat"], "furn_a": [[], []], "furn_b": [[], []]}
    batch = pa.RecordBatch.from_pydict(one)
    rows = [r for b in scans._read(SimpleNamespace(value=np.zeros(0, np.uint64)), shared, False)(iter([batch])) for r in b.to_pylist() if r["kind"]]
    assert len(calls) == 1 and len(rows) == 2
    assert {*rows[0]["words"]} >= {"oldfashioned", "old-fashioned", "rabbit", "rab-bit", "ran"} and {*rows[1]["words"]} == {"the", "cat", "rat"}
    assert {*rows[0]["spelled"]} == {scans.glyphs("old-fashioned"), scans.glyphs("rab-bit")} and rows[0]["begins"] == ["a-"]
    assert [[r[c] for c in ("first_a", "last_a", "first_b", "last_b")] for r in rows] == [["an", "a", None, None], ["the", None, "the", None]]


def test_the_next_page_is_the_nearest_that_has_words(spark):
    """A blank half page is passed over, one with words isn't, nor are two pages; a page delivered twice goes on as often."""
    rows = [(1, "A", 1, None, "so the ket-", None), (2, "A", 2, None, "tle ran", None), (2, "A", 2, None, "tle ran", None), (3, "B", 1, None, "so the gar-", None), (4, "B", 4, None, "den ran", None)]
    half = [(5, "C", 1, "left", "so the rab-"), (6, "C", 1, "right", " \n"), (7, "C", 2, "left", "bit ran"), (8, "D", 1, "left", "so the bot-"), (9, "D", 1, "right", "tle ran"), (10, "D", 2, "left", "tle sat")]
    ocr, _, lib = _tables(spark, rows)
    got = sorted((r.page_id, r.text) for r in scans.clean(ocr, spark.createDataFrame(half, REC), lib).collect() if r.page_id != 3)
    assert got == [(1, "so the kettle"), (2, "ran"), (2, "ran"), (4, "den ran"), (5, "so the rabbit"), (6, ""), (7, "ran"), (8, "so the bottle"), (9, "ran"), (10, "tle sat")]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=12))
def test_glyphs_are_those_of_decomposed_text(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    assert scans.glyphs(text) == plain.translate(str.maketrans(scans._PARTS))


def test_words_are_the_same_one_by_one_and_in_turn():
    own, broken, over = scans.tokens([(2, "rab- bit x- y fash-"), (3, ""), (5, "ioned a-")], None, None, "ga")
    assert [own[i] for i in range(len(own.words))] == list(own) == [("garab-", 0, 2, 2), ("bit", 2, 2, 3), ("x-", 2, 2, 2), ("y", 2, 2, 1), ("fashioned", 2, 5, 4)]
    assert broken == [2, 5] and over
