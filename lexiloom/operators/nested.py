"""Turning nested documents into flat tables that keep their parents (problem 3).

Every record of a document (an element of an array, an entry of a map) gets a Dewey label: the ordinals on the way from
the root down to it. The label of its parent is its own without the last ordinal. Records with the same schema path, the
member names on the way, make up one table. Plain objects belong to the record that holds them, with dotted names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.jsontext import loads

NODES = "row_id bigint, path string, label array<int>, name string, members map<string,string>"
_KIND = pa.schema([("row_id", pa.int64()), ("path", pa.string()), ("label", pa.list_(pa.int32())), ("name", pa.string()), ("members", pa.map_(pa.string(), pa.string()))])


def _scalar(v) -> str:
    """A value as text; half of a surrogate pair, which JSON may have, becomes U+FFFD."""
    if not isinstance(v, str):
        return json.dumps(v)
    return v if v.isascii() else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def shred(text: str | None, root: str, maps: frozenset[str], wanted: frozenset[str] | None = None) -> list[tuple]:
    """``(path, label, name, members)`` of every record; nothing if the text isn't valid JSON as a whole. Documents of any depth.

    ``root`` names the array of a document that is itself an array. Null elements take an ordinal but are no records. With ``wanted``
    only records of these paths come out, and only what leads to them is looked at; without it, arrays nested n deep have labels of n * n / 2
    ordinals together.
    """
    try:
        doc = loads(text) if text else None
    except ValueError:
        return []
    out: list[tuple] = []
    stack: list[tuple] = []
    leads = lambda path: wanted is None or path in wanted or any(w.startswith((f"{path}.", f"{path}[")) for w in wanted)

    def inline(value: dict, path: str, label: tuple, members: list, prefix: str) -> None:
        todo = [(value, path, prefix)]
        while todo:
            obj, at, pre = todo.pop()
            for k, v in obj.items():
                here = f"{at}.{k}" if at else k
                if isinstance(v, list) or here in maps and isinstance(v, dict):
                    if leads(here):
                        stack.append((v, here, label))
                elif isinstance(v, dict):
                    todo.append((v, here, f"{pre}{k}."))
                elif v is not None:
                    members.append((_scalar(pre + k), _scalar(v)))

    if isinstance(doc, list):
        if leads(root):
            stack.append((doc, root, ()))
    elif isinstance(doc, dict):
        top: list = []
        inline(doc, "", (), top, "")
        if wanted is None or "" in wanted:
            out.append(("", (), None, top))
    while stack:
        group, path, label = stack.pop()
        named, kept = isinstance(group, dict), wanted is None or path in wanted
        for i, (name, v) in enumerate(group.items() if named else ((None, x) for x in group)):
            if v is None:
                continue
            own, members = (*label, i), []
            if isinstance(v, dict):
                inline(v, path, own, members, "")
            elif isinstance(v, list):
                if leads(f"{path}[]"):
                    stack.append((v, f"{path}[]", own))
            else:
                members.append(("value", _scalar(v)))
            if kept:
                out.append((_scalar(path), own, name and _scalar(name), members))
    return out


def nodes(df: DataFrame, key: str, column: str, root: str = "", maps: tuple[str, ...] = (), wanted: tuple[str, ...] | None = None) -> DataFrame:
    """All records (with ``wanted``: of these paths) of the JSON documents in ``column``: ``row_id, path, label, name, members``.

    Null, empty and unreadable documents give no rows. Other columns of ``df`` are ignored. One narrow pass, no shuffle.
    """
    known, asked = frozenset(maps), None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for k, text in zip(b.column("k").to_pylist(), b.column("v").to_pylist()):
                for record in shred(text, root, known, asked):
                    for column, x in zip(rows, (k, *record)):
                        column.append(x)
                size += len(text or "")
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _KIND)], schema=_KIND)
                    rows, size = ([], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _KIND)], schema=_KIND)

    return df.select(F.col(key).cast("bigint").alias("k"), F.col(column).alias("v")).filter("v is not null").mapInArrow(run, NODES)


#: Child table -> schema path.
LESSON_TABLES = {"sentence": "sentences", "word": "sentences.audio.words", "note": "sentences.notes", "reviewer": "sentences.notes.reviewers"}
STATE_TABLES = {"vocabulary": "vocabulary", "progress": "progress", "study_day": "studyDays"}
#: Columns of each table: name, member, type.
COLUMNS = {
    "sentence": [("id", "id", "string"), ("english", "english", "string"), ("chinese", "chinese", "string"), ("audio_url", "audio.audioUrl", "string"), ("duration", "audio.duration", "double")],
    "word": [("text", "text", "string"), ("start", "start", "double"), ("end", "end", "double"), ("probability", "probability", "double")],
    "note": [("kind", "kind", "string"), ("text", "text", "string")],
    "reviewer": [("role", "role", "string"), ("accepted", "accepted", "boolean")],
    "vocabulary": [("word", "word", "string"), ("source", "source", "string"), ("added_at", "addedAt", "bigint"), ("correct", "correct", "int"), ("attempts", "attempts", "int")],
    "progress": [("completed", "completed", "int"), ("total", "total", "int"), ("updated_at", "updatedAt", "bigint")],
    "study_day": [("day", "value", "string")],
}


def lesson_nodes(library: DataFrame, *children: str) -> DataFrame:
    """The records of lessons, of all paths or of the given child tables."""
    return nodes(library, "row_id", "sentences_json", root="sentences", wanted=tuple(LESSON_TABLES[c] for c in children) or None)


def state_nodes(states: DataFrame, *children: str) -> DataFrame:
    return nodes(states, "row_id", "state_json", maps=("progress",), wanted=tuple(STATE_TABLES[c] for c in children) or None)


def child_table(found: DataFrame, child: str) -> DataFrame:
    """One flat table: ``row_id``, ``item`` (its label), ``parent_item`` (the label cut by one), ordinal, name and typed columns."""
    path = (LESSON_TABLES | STATE_TABLES)[child]
    rows = found.filter(F.col("path") == path)
    typed = [F.col("members")[m].try_cast(t).alias(c) for c, m, t in COLUMNS[child]]
    parent = F.when(F.size("label") > 1, F.array_join(F.slice("label", 1, F.size("label") - 1).cast("array<string>"), "/"))
    return rows.select("row_id", F.array_join(F.col("label").cast("array<string>"), "/").alias("item"), parent.alias("parent_item"), F.element_at("label", -1).alias("ordinal"), "name", *typed)


def records(library: DataFrame, states: DataFrame) -> DataFrame:
    """``child, row_id, item`` of every record of every child table."""
    wanted = {p: c for c, p in (LESSON_TABLES | STATE_TABLES).items()}
    child = F.element_at(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]), F.col("path"))
    item = F.when(F.col("path") == "progress", F.col("name")).otherwise(F.array_join(F.col("label").cast("array<string>"), "/"))
    both = lesson_nodes(library, *LESSON_TABLES).unionByName(state_nodes(states, *STATE_TABLES))
    return both.select(child.alias("child"), "row_id", item.alias("item"))
