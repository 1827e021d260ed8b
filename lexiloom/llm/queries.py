"""Queries of the training-text problems, and SQL for those that SQL can express."""

from __future__ import annotations

import unicodedata

from lexiloom.llm import boundaries, duplicates, leaks, lookalikes, packing, repetition, scans, truncation
from lexiloom.session import table


def _over(f, *names):
    return lambda spark, d: f(*[table(spark, d, n) for n in names])


def _looks(f):
    return lambda spark, d: f(lookalikes.fields(table(spark, d, "sentences"), table(spark, d, "course_library")))


QUERIES = {
    "p2_found": _over(scans.found, "ocr_pages", "page_records", "course_library"),
    "p2_clean": _over(scans.clean, "ocr_pages", "page_records", "course_library"),
    "p4_found": _over(truncation.found, "sentences"),
    "p4_sources": _over(truncation.by_source, "sentences"),
    "p4_lengths": _over(lambda df: truncation.lengths(truncation.judged(df)).select("source_name", "unit", "length", "n", "at_risk"), "sentences"),
    "p4_limits": _over(lambda df: truncation.limits(truncation.judged(df)), "sentences"),
    "p5_found": _looks(lookalikes.pairs),
    "p5_classes": _looks(lookalikes.classes),
    "p5_canonical": _looks(lambda df: lookalikes.forms(df)),
    "p6_found": _over(boundaries.found, "sentences"),
    "p6_units": _over(boundaries.units, "sentences"),
    "p7_found": _over(duplicates.pairs, "course_library"),
    "p7_collapsed": _over(duplicates.collapsed, "course_library"),
    "p7_copies": _over(lambda df: duplicates.collapsed(df).select("row_id", "copies"), "course_library"),
    "p8_check": _over(packing.checked, "documents", "pack_targets"),
    "p8_packed": _over(packing.packed, "documents", "pack_targets"),
    "p8_fill": _over(packing.fill, "documents", "pack_targets"),
    "p9_found": _over(leaks.found, "documents", "eval_items"),
    "p9_items": _over(leaks.leaked_items, "documents", "eval_items"),
    "p9_cleaned": _over(leaks.cleaned, "documents", "eval_items"),
    "p10_found": _over(repetition.found, "documents"),
    "p10_shares": _over(repetition.shares, "documents"),
    "p10_covered": _over(lambda df: repetition.shares(df).select("doc_id", "n_words", *[f"words_{n}" for n in repetition.LENGTHS]), "documents"),
}

_KEY = r"regexp_replace(lower({}), '[\s\p{{P}}\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1C-\x1F]+', '', 'g')"
_GROUPS = f"SELECT row_id, min(row_id) OVER w AS first, count(*) OVER w AS copies FROM (SELECT row_id, {_KEY.format('level')} AS l, {_KEY.format('title')} AS t FROM course_library WHERE level IS NOT NULL AND title IS NOT NULL) WINDOW w AS (PARTITION BY l, t)"
_WORDS = "regexp_extract_all(lower({}), '[a-zà-öø-ÿ0-9]+')"


def _grams(table: str, key: str, n: int) -> str:
    """``key, i, g``: the n-grams of each text and where they begin."""
    words = f"SELECT {key}, {_WORDS.format('text')} AS w FROM {table} WHERE text IS NOT NULL"
    return f"SELECT {key}, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM ({words}) WHERE len(w) >= {n})"


_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id', 12)}) d JOIN ({_grams('eval_items', 'item_id', 12)}) e USING (g)"


#: Letters and the Latin letters they look like, as the Unicode tables of confusable characters have them.
_CONFUSABLE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ν": "v", "ι": "i", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "‐": "-", "‑": "-", "﹣": "-", "－": "-",
}


def _looks_sql() -> str:
    """``f, row_id, x, key``: a key in which every look-alike is folded, whatever its word, made with plain string functions."""
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    pairs = {**dict(zip(wide, narrow)), **_CONFUSABLE, "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï"}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    # translate() sees a doubled quote as one character
    fold = f"translate(x, {quoted(''.join(pairs))}, {quoted(''.join(pairs.values()))})"
    for code in range(0xFB00, 0xFB05):
        fold = f"replace({fold}, chr({code}), '{unicodedata.normalize('NFKC', chr(code))}')"
    unseen = r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{034F}\x{FE00}-\x{FE0F}\x00-\x08\x0E-\x1B\x7F]"
    blank = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
    key = f"nfc_normalize(regexp_replace(regexp_replace({fold}, '{unseen}', '', 'g'), '{blank}', ' ', 'g'))"
    rows = "SELECT 'sentences.english' AS f, row_id, english AS x FROM sentences WHERE english IS NOT NULL UNION ALL SELECT 'course_library.title', row_id, title FROM course_library WHERE title IS NOT NULL"
    return f"SELECT f, row_id, x, {key} AS key FROM ({rows})"


def _covered_sql() -> str:
    """Words of each document in runs of 2, 4, 6 and 10 words that also begin earlier in it."""
    parts = [f"SELECT doc_id, {n} AS n, count(DISTINCT i + o) AS covered FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM ({_grams('documents', 'doc_id', n)})) CROSS JOIN (SELECT unnest(generate_series(0, {n - 1})) AS o) WHERE k > 1 GROUP BY 1" for n in (2, 4, 6, 10)]
    columns = ", ".join(f"coalesce(max(covered) FILTER (WHERE n = {n}), 0)::INTEGER AS words_{n}" for n in (2, 4, 6, 10))
    return f"WITH c AS ({' UNION ALL '.join(parts)}) SELECT doc_id, coalesce(len({_WORDS.format('any_value(text)')}), 0)::INTEGER AS n_words, {columns} FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id"


SQL: dict[str, str] = {
    "p7_copies": f"SELECT row_id, copies FROM ({_GROUPS}) WHERE row_id = first UNION ALL SELECT row_id, 1 FROM course_library WHERE level IS NULL OR title IS NULL",
    "p8_check": "SELECT target_id, count(*)::BIGINT AS documents, count(*) FILTER (WHERE coalesce(text, '') = '')::BIGINT AS empty, 0::BIGINT AS overfull, 0::BIGINT AS needless, 0::BIGINT AS gaps FROM documents CROSS JOIN pack_targets GROUP BY 1",
    "p10_covered": _covered_sql(),
    "p5_found": f"WITH k AS ({_looks_sql()}) SELECT a.f AS field_name, a.row_id AS row_id_a, b.row_id AS row_id_b FROM k a JOIN k b ON a.f = b.f AND a.key = b.key AND a.row_id < b.row_id AND a.x <> b.x",
    "p5_classes": f"WITH k AS ({_looks_sql()}), g AS (SELECT f, key, min(row_id) AS class_id, count(DISTINCT x)::BIGINT AS n_spellings FROM k GROUP BY 1, 2) SELECT f AS field_name, row_id, class_id, n_spellings FROM k JOIN g USING (f, key) WHERE n_spellings > 1",
    "p4_lengths": """WITH n AS (SELECT source_name, unit, CASE unit WHEN 'chars' THEN length(english) ELSE strlen(english) END::INTEGER AS length, count(*) AS n
FROM sentences CROSS JOIN (SELECT unnest(['chars', 'bytes']) AS unit) WHERE english IS NOT NULL GROUP BY ALL)
SELECT source_name, unit, length, n::BIGINT AS n, (sum(n) OVER (PARTITION BY source_name, unit ORDER BY length DESC))::BIGINT AS at_risk FROM n""",
    "p7_found": f"SELECT first AS row_id_a, row_id AS row_id_b FROM ({_GROUPS}) WHERE row_id <> first",
    "p9_found": _LEAKS,
    "p9_items": f"SELECT item_id, split_name, coalesce(n, 0)::BIGINT AS n_documents FROM eval_items LEFT JOIN (SELECT item_id, count(*) AS n FROM ({_LEAKS}) GROUP BY 1) USING (item_id)",
    "p10_found": f"""
WITH g AS ({_grams('documents', 'doc_id', 6)}), r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM g),
c AS (SELECT doc_id, count(DISTINCT i + o) AS covered FROM r CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS o) WHERE k > 1 GROUP BY 1)
SELECT doc_id FROM c JOIN documents USING (doc_id) WHERE covered * 10 >= 3 * len({_WORDS.format('text')})""",
}
