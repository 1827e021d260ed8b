"""Queries of the general data problems: records that don't parse, and nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import nested, rejects
from lexiloom.session import table


def p1_found(spark, d):
    return rejects.rejected(table(spark, d, "course_csv")).select("row_id", "reason")


def p1_loaded(spark, d):
    return rejects.loaded(table(spark, d, "course_csv"))


def p1_reasons(spark, d):
    return rejects.judged(table(spark, d, "course_csv")).groupBy(F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def p3_found(spark, d):
    return nested.records(table(spark, d, "course_library"), table(spark, d, "student_learning_state"))


def _child(name):
    def query(spark, d):
        if name in nested.LESSON_TABLES:
            return nested.child_table(nested.lesson_nodes(table(spark, d, "course_library"), name), name)
        return nested.child_table(nested.state_nodes(table(spark, d, "student_learning_state"), name), name)

    return query


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_reasons": p1_reasons, "p3_found": p3_found} | {
    f"p3_{c}": _child(c) for c in (*nested.LESSON_TABLES, *nested.STATE_TABLES)
}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_NAMES = {c: "[" + ", ".join(f"'{n}'" for n in names) + "]" for c, names in rejects.HEADER_NAMES.items()}


def _sql_csv() -> str:
    """Well-formed records by one expression over the whole record; fields one by one behind an extra comma."""
    fields = f"list_transform(regexp_extract_all(',' || line, ',({_FIELD})', 1), lambda x: CASE WHEN starts_with(x, '\"') THEN replace(x[2:-2], '\"\"', '\"') ELSE x END)"
    trim = lambda x: f"regexp_replace(regexp_replace({x}, '^[\\s\\x{{A0}}\\x{{3000}}]+', ''), '[\\s\\x{{A0}}\\x{{3000}}]+$', '')"
    at = {c: f"list_position(names, list_filter(names, lambda x: list_contains({ns}, x))[1])" for c, ns in _NAMES.items()}
    get = lambda c: f"CASE WHEN {at[c]} > 0 THEN fields[{at[c]}] END"
    return f"""
WITH lines AS (SELECT *, regexp_replace(raw_line, '\\r$', '') AS line FROM course_csv),
h AS (SELECT file_name, list_transform({fields}, lambda x: lower({trim("replace(x, chr(65279), '')")})) AS names FROM lines WHERE record_no = 0),
d AS (SELECT row_id, file_name, record_no, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*', 's') AS ok, {fields} AS fields FROM lines WHERE record_no > 0 AND line <> ''),
v AS (SELECT *, {trim(get("level"))} AS l, {trim(get("lesson_id"))} AS i, {get("english")} AS e, {get("title")} AS title, {get("title_zh")} AS title_zh, {get("sentence_id")} AS sid, {get("chinese")} AS chinese FROM d LEFT JOIN h USING (file_name)),
r AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN len(fields) <> coalesce(len(names), -1) THEN 'column_count'
  WHEN NOT coalesce(regexp_full_match(l, 'aa|[A-Z]') AND regexp_full_match(i, 'RAZ-(?:aa|[A-Z])-[0-9]{{3,}}') AND regexp_matches(e, '\\p{{L}}') AND NOT regexp_matches(e, '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{7F}}-\\x{{9F}}]'), false) THEN 'value' END AS reason FROM v)
"""


def _sql_children() -> dict[str, str]:
    """The records of each child table; elements that are null count but don't come out."""
    lib = "SELECT row_id, unnest(from_json(j, '[\"json\"]')) AS s, generate_subscripts(from_json(j, '[\"json\"]'), 1) - 1 AS a FROM (SELECT row_id, CASE WHEN json_type(sentences_json) = 'ARRAY' THEN sentences_json::JSON ELSE json_extract(sentences_json, '$.sentences') END AS j FROM course_library WHERE json_valid(sentences_json)) WHERE json_type(j) = 'ARRAY'"

    def below(inner: str, item: str, path: str) -> str:
        x = f"json_extract(s, '{path}')"
        return f"SELECT row_id, unnest(from_json({x}, '[\"json\"]')) AS s, {item} || '/' || (generate_subscripts(from_json({x}, '[\"json\"]'), 1) - 1) AS item FROM ({inner}) WHERE json_type({x}) = 'ARRAY'"

    sentence = f"SELECT row_id, s, a::VARCHAR AS item FROM ({lib}) WHERE s IS NOT NULL AND json_type(s) <> 'NULL'"
    live = lambda q: f"SELECT * FROM ({q}) WHERE s IS NOT NULL AND json_type(s) <> 'NULL'"
    word, note = live(below(sentence, "item", "$.audio.words")), live(below(sentence, "item", "$.notes"))
    state = lambda member: f"SELECT row_id, s, a::VARCHAR AS item FROM (SELECT row_id, unnest(from_json(json_extract(state_json, '$.{member}'), '[\"json\"]')) AS s, generate_subscripts(from_json(json_extract(state_json, '$.{member}'), '[\"json\"]'), 1) - 1 AS a FROM student_learning_state WHERE json_valid(state_json) AND json_type(json_extract(state_json, '$.{member}')) = 'ARRAY') WHERE s IS NOT NULL AND json_type(s) <> 'NULL'"
    progress = "SELECT row_id, NULL AS s, unnest(json_keys(state_json, '$.progress')) AS item FROM student_learning_state WHERE json_valid(state_json) AND json_type(json_extract(state_json, '$.progress')) = 'OBJECT'"
    return {"sentence": sentence, "word": word, "note": note, "reviewer": live(below(note, "item", "$.reviewers")), "vocabulary": state("vocabulary"), "study_day": state("studyDays"), "progress": progress}


def _sql_child(child: str, query: str) -> str:
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT"}
    value = lambda m: "json_extract_string(s, '$')" if m == "value" else f"json_extract_string(s, '$.{m}')"
    typed = ", ".join(f'try_cast({value(m)} AS {kinds[t]}) AS "{c}"' for c, m, t in nested.COLUMNS[child])
    return f"SELECT row_id, item, CASE WHEN contains(item, '/') THEN regexp_replace(item, '/[0-9]+$', '') END AS parent_item, regexp_extract(item, '[0-9]+$')::INTEGER AS ordinal, NULL::VARCHAR AS name, {typed} FROM ({query})"


def _sql_progress() -> str:
    """Entries of an object: the member's name is the record's, its place among the members its ordinal; null entries don't come out."""
    keys = "SELECT row_id, unnest(json_keys(state_json, '$.progress')) AS name, generate_subscripts(json_keys(state_json, '$.progress'), 1) - 1 AS ordinal, json_extract(state_json, '$.progress') AS p FROM student_learning_state WHERE json_valid(state_json) AND json_type(json_extract(state_json, '$.progress')) = 'OBJECT'"
    value = lambda m, t: f"try_cast(json_extract_string(p, '$.\"' || name || '\".{m}') AS {t})"
    return f"SELECT row_id, ordinal::VARCHAR AS item, NULL::VARCHAR AS parent_item, ordinal::INTEGER AS ordinal, name, {value('completed', 'INTEGER')} AS completed, {value('total', 'INTEGER')} AS total, {value('updatedAt', 'BIGINT')} AS updated_at FROM ({keys})"


SQL: dict[str, str] = {
    "p1_found": _sql_csv() + "SELECT row_id, reason FROM r WHERE reason IS NOT NULL",
    "p1_reasons": _sql_csv() + "SELECT coalesce(reason, 'loaded') AS outcome, count(*)::BIGINT AS n FROM r GROUP BY 1",
    "p3_found": " UNION ALL ".join(f"SELECT '{c}' AS child, row_id, item FROM ({q})" for c, q in _sql_children().items()),
    "p1_loaded": _sql_csv() + "SELECT row_id, file_name, record_no, l AS level, i AS lesson_id, coalesce(title, '') AS title, coalesce(title_zh, '') AS title_zh, coalesce(nullif(sid, ''), i || '-' || record_no) AS sentence_id, e AS english, coalesce(chinese, '') AS chinese FROM r WHERE reason IS NULL",
} | {f"p3_{c}": _sql_child(c, q) for c, q in _sql_children().items() if c != "progress"} | {"p3_progress": _sql_progress()}


_CSV_GOOD = _sql_csv() + """, g AS (SELECT row_id, l AS level, i AS lesson_id, coalesce(title, '') AS title, coalesce(title_zh, '') AS title_zh, coalesce(nullif(sid, ''), i || '-' || record_no) AS sid, e AS english, coalesce(chinese, '') AS chinese FROM r WHERE reason IS NULL AND coalesce(title, '') <> '' AND e <> '')
"""
SQL["csv_lessons"] = _CSV_GOOD + "SELECT level, lesson_id, min(row_id) AS first_row, arg_min(title, row_id) AS title, arg_min(title_zh, row_id) AS title_zh, count(*)::BIGINT AS n_sentences FROM g GROUP BY 1, 2"
SQL["csv_lesson_sentences"] = _CSV_GOOD + "SELECT level, lesson_id, row_number() OVER (PARTITION BY level, lesson_id ORDER BY row_id)::BIGINT AS position, sid AS id, english, chinese FROM g"
