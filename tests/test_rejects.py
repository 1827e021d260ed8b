import csv
import io
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.operators import rejects

SCHEMA = "row_id bigint, file_name string, record_no int, raw_line string, received_at string, fields string"
FIELD = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', re.S)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('",a\n\r é', max_size=12), max_size=8))
def test_tokenizer_against_an_expression(lines):
    fields, at = rejects.tokenize(lines)
    for line, own, offset in zip(lines, fields, at):
        assert (own is not None) == bool(FIELD.fullmatch(line)) == (offset is None)
        if offset is not None:
            assert 0 <= offset < max(len(line), 1)
            assert FIELD.fullmatch(line[:offset]) or line[:offset].endswith(('"', ",")) or '"' in line[:offset]


def test_fields_as_the_csv_module_reads_them():
    line = 'a,"b ""c"", d",,"x\ny",'
    assert rejects.tokenize([line])[0][0] == next(csv.reader(io.StringIO(line, newline="")))


def _judge(spark, rows):
    df = spark.createDataFrame([(i, f, n, r, None, "clash") for i, (f, n, r) in enumerate(rows)], SCHEMA)
    return {x.row_id: x for x in rejects.judged(df).collect()}


def test_reasons_and_rows(spark):
    head = "\ufeff Level ,课程id,title,English,sentenceid"
    rows = [
        ("a", 0, head), ("a", 1, 'B,RAZ-B-001,T,"Hi, you.",'), ("a", 2, 'B,RAZ-B-001,T,"Hi,S1'), ("a", 3, "B,RAZ-B-001,T,Hi"), ("a", 4, "b,RAZ-B-001,T,Hi,S1"), ("a", 5, "B,RAZ-B-1,T,Hi,S1"),
        ("a", 6, "B,RAZ-B-001,T,- 5,S1"), ("a", 7, "B,RAZ-B-001,T,H\x07i,S1"), ("a", 8, " B ,RAZ-B-001 ,T,猫\t!,S1\r"), ("a", 9, "\r"), ("a", 10, ""), ("a", 11, None), ("x", 1, "B,RAZ-B-001,T,Hi,S1"),
        ("a", 12, 'B,RAZ-B-001,T,Hi "you",S1'), ("a", 13, "B,RAZ-B-001,T,bad �,S1"), ("a", 1, 'B,RAZ-B-001,T,"Hi, you.",'),
    ]
    got = _judge(spark, rows)
    assert {i: r.reason for i, r in got.items()} == {1: None, 2: "quoting", 3: "column_count", 4: "value", 5: "value", 6: "value", 7: "value", 8: None, 12: "column_count", 13: "quoting", 14: "value", 15: None}
    assert got[2].error_at == 14 and got[13].error_at == 17
    assert (got[1].english, got[1].sentence_id) == ("Hi, you.", "RAZ-B-001-1") and got[8].level == "B" and got[8].lesson_id == "RAZ-B-001"


def test_empty_table_and_long_record(spark):
    assert _judge(spark, []) == {}
    long = "B,RAZ-B-001,T," + "word " * 200_000 + ",S"
    got = _judge(spark, [("a", 0, "level,lesson_id,title,english,sentence_id"), ("a", 1, long), ("a", 2, '"' * 99_999)])
    assert got[1].reason is None and len(got[1].english) == 1_000_000 and got[2].reason == "quoting"


def test_salted_join_gives_the_same(spark, monkeypatch):
    import lexiloom.session as session

    rows = [(f"f{i % 3}", n, "level,lesson_id,title,english" if n == 0 else "A,RAZ-A-001,T,Hi") for i in range(3) for n in range(5)]
    small = _judge(spark, rows)
    monkeypatch.setattr(session, "fits_broadcast", lambda *_: False)
    assert _judge(spark, rows) == small and len(small) == 12
