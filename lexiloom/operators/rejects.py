"""Separating the records of a delimited file that don't parse from those that load (problem 1).

The tokenizer is a five-state machine over quote, comma, other and end of record. Records of a batch are laid end to end
and processed as chunks whose transition functions are composed (:mod:`lexiloom.functions.fsm`), so one very long record is
no slower than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.fsm import Machine, code_points, slices
from lexiloom.session import join_small

BEGIN, BARE, QUOTED, CLOSED, BROKEN = range(5)
OTHER, QUOTE, COMMA, END = range(4)
_TABLE = np.zeros((5, 4), dtype=np.uint8)
_TABLE[BEGIN] = [BARE, QUOTED, BEGIN, BEGIN]
_TABLE[BARE] = [BARE, BROKEN, BEGIN, BEGIN]
_TABLE[QUOTED] = [QUOTED, CLOSED, QUOTED, BEGIN]
_TABLE[CLOSED] = [BROKEN, QUOTED, BEGIN, BEGIN]
_TABLE[BROKEN] = [BROKEN, BROKEN, BROKEN, BEGIN]
RECORD = Machine(_TABLE)

#: The header names that the import accepts, in lower case.
HEADER_NAMES = {
    "level": ["level", "级别"],
    "lesson_id": ["lesson_id", "lessonid", "课程id"],
    "title": ["lesson_title", "title", "课程名", "英文课程名"],
    "title_zh": ["lesson_title_zh", "title_zh", "中文课程名"],
    "sentence_id": ["sentence_id", "sentenceid", "句子id"],
    "english": ["english", "text", "英文", "原文"],
    "chinese": ["chinese", "translation", "中文", "翻译"],
}
LEVEL = r"\A(?:aa|[A-Z])\z"
LESSON = r"\ARAZ-(?:aa|[A-Z])-[0-9]{3,}\z"


def tokenize(records: list[str]) -> tuple[list[list[str] | None], list[int | None]]:
    """The fields of each record, or None and the offset at which its quoting breaks (where an unclosed quote opens)."""
    codes, begins = code_points(records)
    ends = begins[1:] - 1
    symbols = np.zeros(len(codes), dtype=np.uint8)
    symbols[codes == ord('"')] = QUOTE
    symbols[codes == ord(",")] = COMMA
    symbols[ends] = END
    state = RECORD.before(symbols)
    last = state[ends]
    bad = (last == QUOTED) | (last == BROKEN)
    cuts = np.flatnonzero(((symbols == COMMA) & (state != QUOTED)) | (symbols == END))
    edge = np.searchsorted(cuts, begins)
    to_broken = np.flatnonzero((state[1:] == BROKEN) & (state[:-1] != BROKEN))
    opens = np.flatnonzero((state == BEGIN) & (symbols == QUOTE))
    fields: list[list[str] | None] = []
    offsets: list[int | None] = []
    for i, record in enumerate(records):
        base = int(begins[i])
        if bad[i]:
            fields.append(None)
            if last[i] == QUOTED:
                offsets.append(int(opens[np.searchsorted(opens, ends[i]) - 1]) - base)
            else:
                offsets.append(int(to_broken[np.searchsorted(to_broken, base)]) - base)
            continue
        at, row = 0, []
        for c in cuts[edge[i] : edge[i + 1]].tolist():
            field = record[at : c - base]
            row.append(field[1:-1].replace('""', '"') if field[:1] == '"' else field)
            at = c - base + 1
        fields.append(row)
        offsets.append(None)
    return fields, offsets


_OUT = "row_id bigint, file_name string, record_no int, fields array<string>, broken_at int"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("row_id", pa.int64()), ("file_name", pa.string()), ("record_no", pa.int32()), ("fields", pa.list_(pa.string())), ("broken_at", pa.int32())])
    for b in batches:
        lines = [x or "" for x in b.column("raw_line").to_pylist()]
        for i, j in slices(lines):
            part = [x[:-1] if x[-1:] == "\r" else x for x in lines[i:j]]
            fields, at = tokenize(part)
            keep = [b.column(c).slice(i, j - i) for c in ("row_id", "file_name", "record_no")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(fields, kind[3].type), pa.array(at, pa.int32())], schema=kind)


def tokenized(records: DataFrame) -> DataFrame:
    """``row_id, file_name, record_no, fields, broken_at`` of raw records; ``fields`` is null where quoting breaks."""
    return records.select("row_id", "file_name", F.col("record_no").cast("int").alias("record_no"), "raw_line").mapInArrow(_batches, _OUT)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def headers(records: DataFrame) -> DataFrame:
    """One row per file: the number of columns and the 1-based place of each known column (0: absent).

    A file with several header records counts by the one with the smallest ``row_id``.
    """
    h = tokenized(records.filter("record_no = 0")).groupBy("file_name").agg(F.min_by(F.coalesce("fields", F.array().cast("array<string>")), "row_id").alias("names"))
    clean = F.transform("names", lambda x: F.lower(_trim(F.regexp_replace(x, "\ufeff", ""))))
    at = [
        F.coalesce(F.expr(f"get(filter(transform(clean, (x, i) -> if(x in ({', '.join(repr(n) for n in names)}), i + 1, null)), x -> x is not null), 0)"), F.lit(0)).alias(f"at_{c}")
        for c, names in HEADER_NAMES.items()
    ]
    return h.select("file_name", F.size("names").alias("n_columns"), clean.alias("clean")).select("file_name", "n_columns", *at)


def judged(records: DataFrame) -> DataFrame:
    """Every data record with its typed columns and ``reason``, null where it loads.

    Takes ``row_id, file_name, record_no, raw_line`` (others are ignored). Empty and null records are left out. The first
    that holds of ``quoting``, ``column_count`` and ``value`` counts; ``error_at`` is the offset at which quoting breaks.
    A record whose file has no header fails by ``column_count``; one whose header lacks a required column by ``value``.
    An absent sentence id becomes ``lesson_id-record_no``. Repeated records all come out. Hot files: the one row per file
    of the header side is broadcast when proven small, else both sides are salted.
    """
    data = tokenized(records.filter("record_no > 0 and raw_line is not null and raw_line not in ('', '\\r')"))
    j = join_small(data, headers(records), "file_name", "left")
    get = {c: F.when(F.col(f"at_{c}") > 0, F.try_element_at("fields", F.col(f"at_{c}"))) for c in HEADER_NAMES}
    level, lesson, english = _trim(get["level"]), _trim(get["lesson_id"]), get["english"]
    usable = level.rlike(LEVEL) & lesson.rlike(LESSON) & english.rlike(r"\p{L}") & ~english.rlike(r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")
    reason = (
        F.when(F.col("fields").isNull(), "quoting")
        .when(F.size("fields") != F.coalesce("n_columns", F.lit(-1)), "column_count")
        .when(~F.coalesce(usable, F.lit(False)), "value")
    )
    sid = F.coalesce(F.nullif(get["sentence_id"], F.lit("")), F.concat_ws("-", lesson, F.col("record_no")))
    return j.select(
        "row_id", "file_name", "record_no", reason.alias("reason"), F.col("broken_at").alias("error_at"), level.alias("level"), lesson.alias("lesson_id"),
        F.coalesce(get["title"], F.lit("")).alias("title"), F.coalesce(get["title_zh"], F.lit("")).alias("title_zh"), sid.alias("sentence_id"),
        english.alias("english"), F.coalesce(get["chinese"], F.lit("")).alias("chinese"),
    )


def rejected(records: DataFrame) -> DataFrame:
    """``row_id, reason, error_at`` of the records that fail."""
    return judged(records).filter("reason is not null").select("row_id", "reason", "error_at")


def loaded(records: DataFrame) -> DataFrame:
    """The lesson sentences of the records that load."""
    return judged(records).filter("reason is null").drop("reason", "error_at")
