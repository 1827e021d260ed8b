"""Queries of the page operators: sizes, families, columns, markers, scans, covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import layout
from lexiloom.plans.reference import _line
from lexiloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(*names: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(*[table(spark, d, n) for n in names])
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Words of the extracted pages: size and font by line, made up from the page's size and alternate family.
_WORDS = """lines AS (SELECT lesson_id AS doc, page_id, body_size, coalesce(alternate_family, 'Sans') AS alt, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM page_records WHERE text IS NOT NULL AND lesson_id IS NOT NULL AND body_size IS NOT NULL),
words AS (SELECT doc, page_id AS page, l, body_size + CASE WHEN l = 0 THEN 2.5 ELSE 0 END AS size, 'ABCDEF+' || CASE WHEN l % 4 = 1 THEN alt ELSE 'Body' END || CASE WHEN l = 0 THEN '-Bold' ELSE '-Roman' END AS font, regexp_matches(line, '[.!?]["''’”)]*$') AS ends_sentence,
  unnest(regexp_extract_all(line, '\\S+')) AS text, generate_subscripts(regexp_extract_all(line, '\\S+'), 1) - 1 AS i FROM lines),
w AS (SELECT *, page * 100000 + l * 1000 + i AS seq, len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) AS n, round(size, 1) AS rs FROM words)"""


def _words(records):
    r = records.filter("text is not null and lesson_id is not null and body_size is not null")
    lines = r.select(F.col("lesson_id").alias("doc"), F.col("page_id").alias("page"), "body_size", F.coalesce("alternate_family", F.lit("Sans")).alias("alt"), F.posexplode(F.split("text", "\n")).alias("l", "line"))
    font = F.concat(F.lit("ABCDEF+"), F.when(F.col("l") % 4 == 1, F.col("alt")).otherwise("Body"), F.when(F.col("l") == 0, "-Bold").otherwise("-Roman"))
    w = lines.select("doc", "page", "l", (F.col("body_size") + F.when(F.col("l") == 0, 2.5).otherwise(0.0)).alias("size"), font.alias("font"), X.has_final_mark(F.col("line")).alias("ends_sentence"), F.posexplode(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0))).alias("i", "text"))
    return w.withColumn("seq", F.col("page") * 100000 + F.col("l") * 1000 + F.col("i"))


_SIZES = """strict AS (SELECT doc, rs, sum(n) AS g, min(seq) AS f FROM w WHERE rs >= 9 AND n > 0 AND ends_sentence GROUP BY 1, 2), loose AS (SELECT doc, rs, sum(n) AS g, min(seq) AS f FROM w WHERE rs >= 9 AND n > 0 GROUP BY 1, 2),
sizes AS (SELECT doc, rs AS value, g::BIGINT AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY g DESC, f) AS k FROM (SELECT * FROM strict UNION ALL SELECT * FROM loose WHERE doc NOT IN (SELECT doc FROM strict))) WHERE k = 1)"""


@query("page_records", sql=f"WITH {_WORDS}, {_SIZES} SELECT * FROM sizes")
def body_sizes(records):
    """The size of the body text of each document."""
    return layout.dominant_size(_words(records))


@query("page_records", sql=f"""
WITH {_WORDS}, {_SIZES}, fam AS (SELECT w.doc, regexp_replace(regexp_replace(lower(font[strpos(font, '+') + 1:]), '-(?:bold|italic|roman|regular|medium|semibold|cn).*', ''), '[^a-z0-9]', '', 'g') AS family, sum(n) AS g, min(seq) AS f FROM w JOIN sizes USING (doc) WHERE abs(size - value) <= 0.75 AND n > 0 GROUP BY 1, 2)
SELECT doc, family AS value, g::BIGINT AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY g DESC, f) AS k FROM fam) WHERE k = 1""")  # fmt: skip
def body_families(records):
    """The font family of the body text."""
    w = _words(records)
    return layout.dominant_family(w, layout.dominant_size(w))


@query("page_records", sql=f"""
WITH {_WORDS}, {_SIZES}, own AS (SELECT doc, page, rs, g FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY g DESC, f) AS k FROM (SELECT doc, page, rs, sum(n) AS g, min(seq) AS f FROM w WHERE n > 0 GROUP BY 1, 2, 3)) WHERE k = 1)
SELECT doc, page, CASE WHEN g >= 20 AND abs(rs - value) <= 4.0 THEN rs ELSE value END AS size FROM own JOIN sizes USING (doc)""")  # fmt: skip
def page_sizes(records):
    """The size of the body text of each page, if it has enough letters of its own."""
    w = _words(records)
    return layout.page_size(w, layout.dominant_size(w))


@query("page_records", sql=f"""
WITH {_WORDS}, {_SIZES}, fs AS (SELECT doc, page, regexp_replace(regexp_replace(lower(font[strpos(font, '+') + 1:]), '-(?:bold|italic|roman|regular|medium|semibold|cn).*', ''), '[^a-z0-9]', '', 'g') AS family, rs AS size, sum(n) AS g, min(seq) AS f FROM w WHERE n > 0 GROUP BY 1, 2, 3, 4)
SELECT doc, page, family, size, g::BIGINT AS chars FROM (SELECT fs.*, row_number() OVER (PARTITION BY fs.doc, page ORDER BY g DESC, f) AS k FROM fs JOIN sizes USING (doc) WHERE family <> 'body' AND g >= 10 AND abs(size - value) <= 3) WHERE k = 1""")  # fmt: skip
def alternate_families(records):
    """The strongest block of another family than the body's on each page."""
    w = _words(records)
    sizes = layout.dominant_size(w)
    body = sizes.select("doc", F.lit("body").alias("value"))
    return layout.alternate_blocks(w, sizes, body, least=10)


@query("page_records", sql="""
WITH p AS (SELECT page_id, text, lists.l AS l, list_transform(l[:8], lambda x: trim(regexp_replace(lower(x), '[^a-z ]', '', 'g'))) AS clean, l[:12] AS head, lower(l[1]) AS first FROM page_records, LATERAL (SELECT CASE page_id % 6 WHEN 0 THEN ['Table of Contents'] || string_split(text, chr(10)) WHEN 1 THEN ['A', 'Glos', 'sary'] || string_split(text, chr(10)) WHEN 2 THEN ['One.....1', 'Two.....2', 'Three.....3'] ELSE string_split(text, chr(10)) END AS l) lists WHERE text IS NOT NULL),
c AS (SELECT *, list_transform(clean, lambda x: replace(x, ' ', '')) AS compact FROM p), m AS (SELECT page_id, text, l,
  CASE WHEN list_has_any(compact, ['contents', 'tableofcontent', 'tableofcontents']) OR len(list_filter(head, lambda x: contains(x, '...'))) >= 3 OR list_sum(list_transform(head, lambda x: len(regexp_extract_all(x, '[.]{5,}')))) >= 3 THEN 'skip'
  WHEN list_has_any(clean || compact, ['glossary', 'index', 'abouttheauthor', 'bibliography', 'references']) OR regexp_matches(array_to_string(compact[:3], ''), '^(glossary|index|abouttheauthor|bibliography|references)') OR coalesce(first LIKE '% quest' OR first IN ('photo credits', 'connections', 'extension activity'), false) THEN 'stop' END AS marker FROM c)
SELECT page_id, marker, len(list_filter(l, lambda x: NOT regexp_matches(x, '^[0-9]+$') AND NOT contains(lower(x), 'www.') AND NOT regexp_matches(x, '[.]{8,}')))::INTEGER AS body_lines FROM m""")  # fmt: skip
def page_markers(records):
    """Pages of contents and of back matter by their first lines, and how many lines of each may be body text."""
    own = F.split("text", "\n")
    k = F.col("page_id") % 6
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs])
    lines = F.when(k == 0, F.concat(strings("Table of Contents"), own)).when(k == 1, F.concat(strings("A", "Glos", "sary"), own)).when(k == 2, strings("One.....1", "Two.....2", "Three.....3")).otherwise(own)
    p = records.filter("text is not null").select("page_id", lines.alias("l"))
    return p.select("page_id", layout.page_marker(F.col("l")).alias("marker"), F.size(F.filter("l", layout.is_body_line)).alias("body_lines"))


@query("ocr_pages", sql=f"""
WITH p AS (SELECT page_id, page, string_split(vision, chr(10)) AS raw, title FROM ocr_pages WHERE vision IS NOT NULL),
x AS (SELECT *, list_transform(generate_series(1, len(raw)), lambda i: {{'t': {_line('raw[i]')}, 'y': CASE WHEN i > 5 THEN 0.5 ELSE 0.05 * i END, 'h': CASE WHEN i = 2 THEN 0.01 ELSE 0.02 END}}) AS ls FROM p),
k AS (SELECT *, list_filter(ls, lambda z: z.y <= 0.35 AND NOT regexp_matches(z.t, '^[0-9]{{0,2}}$') AND NOT list_bool_or(list_transform(['level d', 'leveled book', 'readinga-z.com', 'reading a-z', 'written by', 'illustrated by', 'word count', 'all rights reserved', 'learning a-z'], lambda q: contains(lower(z.t), q))) AND NOT starts_with(z.t, '©') AND regexp_matches(z.t, '\\p{{L}}')) AS kept FROM x)
SELECT page_id, array_to_string(list_transform(list_filter(kept, lambda z: z.h >= greatest(0.012, list_max(list_transform(kept, lambda q: q.h)) * 0.62)), lambda z: z.t), '|') AS body, page::INTEGER AS number, {_line('title')} AS footer,
  CASE WHEN page % 2 = 0 THEN 'up' ELSE 'down' END AS way, round(list_sum(list_transform(raw, lambda z: greatest(1, length(z)))) * 0.5::DOUBLE, 3) AS score FROM k""")  # fmt: skip
def scan_pages(pages):
    """Story lines of a scanned page, its printed number, the title in its footer, its orientation and its confidence."""
    raw = F.split("vision", "\n")
    line = lambda t, y, h: F.struct(t.alias("text"), y.alias("y"), h.alias("height"))
    ls = F.transform(raw, lambda t, i: line(t, F.when(i > 4, 0.5).otherwise((i + 1) * 0.05), F.when(i == 1, 0.01).otherwise(0.02)))
    p = pages.filter("vision is not null").select("page_id", "page", "title", raw.alias("raw"), ls.alias("ls"))
    number = F.array(line(F.col("page").cast("string"), F.lit(0.01), F.lit(0.02)), line(F.lit("99"), F.lit(0.9), F.lit(0.02)), line(F.lit("x 7"), F.lit(0.0), F.lit(0.02)))
    footer = F.array(F.lit("My Leveled Book • Level D"), F.concat("title", F.lit(" • Level D")), F.lit("Other • Level D"))
    sure = F.transform("raw", lambda t: F.struct(t.alias("text"), F.lit(0.5).alias("confidence")))
    return p.select(
        "page_id", F.array_join(layout.scan_body_lines(F.col("ls")), "|").alias("body"), layout.scan_page_number(number).alias("number"), X.footer_title(footer).alias("footer"),
        layout.upright(F.when(F.col("page") % 2 == 0, 1.0).otherwise(0.5), F.when(F.col("page") % 4 == 0, 1.0).otherwise(0.9)).alias("way"), F.round(layout.confidence_score(sure), 3).alias("score"),
    )


@query("course_library", sql=f"""
WITH t AS (SELECT row_id, {_line("regexp_replace(title, '[?.!:]', ' ', 'g')")} AS a  FROM course_library WHERE title IS NOT NULL)
SELECT row_id, CASE WHEN row_id % 4 = 0 AND len(w) <= 18 AND len(w) <> 1 AND a <> '' THEN a WHEN row_id % 4 = 1 AND len(w) <= 9 AND a <> '' THEN a || ' ' || a ELSE 'Long Way Home' END AS title, 1234 + row_id % 10 AS words, CASE WHEN len(regexp_extract_all(a, '[A-Za-z0-9]+(?:[’''][A-Za-z]+)*(?:-[A-Za-z0-9]+)*')) BETWEEN 1 AND 12 AND row_id % 2 = 0 AND title_like THEN true ELSE false END AS heading, CASE WHEN row_id % 3 = 0 THEN 2 ELSE 0 END AS bold
FROM (SELECT *, len(w) > 0 AND len(list_filter(w, lambda x: NOT (list_contains(['a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with'], lower(x)) OR regexp_matches(x, '^\\p{{Lu}}')))) = 0 AS title_like FROM (SELECT *, regexp_extract_all(a, '[A-Za-z0-9]+(?:[’''][A-Za-z]+)*(?:-[A-Za-z0-9]+)*') AS w FROM t))""")  # fmt: skip
def covers(lib):
    """Titles and word counts from the lines of covers; lines that are bold headings, bold words at a line's start."""
    a = X.normalize_line(F.regexp_replace("title", "[?.!:]", " "), compose=False)
    t = lib.filter("title is not null").select("row_id", a.alias("a"))
    k, marker = F.col("row_id") % 4, F.lit("A Reading A–Z Level D Leveled Book")
    lines = F.when(k == 0, F.array(F.lit("www.x.com"), F.lit("Visit me"), F.col("a"), marker)).when(k == 1, F.array(F.lit("Written by X"), F.col("a"), F.col("a"), marker, F.lit("more"))).when(k == 2, F.array(F.col("a"), F.lit("It ended."), marker)).otherwise(F.array(marker, F.col("a")))
    count = F.concat(F.lit("LEVELED BOOK • D\nWord Count: 1,"), (234 + F.col("row_id") % 10).cast("string"), F.lit(" words"))
    fonts = F.when(F.col("row_id") % 2 == 0, F.array(F.lit("X-Bold"), F.lit("SmallCapitals"))).otherwise(F.array(F.lit("X-Bold"), F.lit("X-Roman")))
    prefix = F.when(F.col("row_id") % 3 == 0, F.array(F.lit("A-Bold"), F.lit("Bold"))).otherwise(F.array(F.lit("Roman"), F.lit("Bold")))
    return t.select("row_id", layout.cover_title(lines, F.lit("Long Way Home")).alias("title"), X.expected_words(count).cast("bigint").alias("words"), X.is_bold_heading(F.col("a"), fonts).alias("heading"), layout.bold_prefix(prefix).alias("bold"))


@query("ocr_pages", sql="""
WITH p AS (SELECT page_id, lesson_id, CASE WHEN page % 3 = 1 THEN title END AS t, page FROM ocr_pages WHERE lesson_id IS NOT NULL)
SELECT page_id, last_value(t IGNORE NULLS) OVER (PARTITION BY lesson_id ORDER BY page, page_id ROWS UNBOUNDED PRECEDING) AS carried FROM p""")  # fmt: skip
def carried_titles(pages):
    """The last title met so far in a lesson, for pages that don't name it."""
    p = pages.filter("lesson_id is not null").select("page_id", "lesson_id", "page", F.when(F.col("page") % 3 == 1, F.col("title")).alias("title"))
    return layout.carried_title(p, ["lesson_id"], ["page", "page_id"]).select("page_id", "carried")


@query("page_records", sql=f"""
WITH {_WORDS}, g AS (SELECT doc, page, l, count(*) AS c FROM w GROUP BY 1, 2, 3)
SELECT page::VARCHAR AS doc, count(*) FILTER (WHERE c >= 3) >= 3 AS split FROM g GROUP BY 1""")  # fmt: skip
def two_column_pages(records):
    """Pages with at least three lines that have a wide gap."""
    x = F.col("i") * 40.0 + F.when(F.col("i") >= 2, 300.0).otherwise(0.0)
    w = _words(records).select(F.col("page").cast("string").alias("doc"), F.lit(1).alias("page"), "text", x.alias("x0"), (x + 35).alias("x1"), (F.col("l") * 14.0).alias("top"), (F.col("l") * 14.0 + 10).alias("bottom"), F.lit(10.0).alias("size"))
    return layout.two_columns(layout.grouped_lines(w), 612.0).select("doc", "split")


@query("ocr_pages", sql="""
WITH p AS (SELECT page_id, lesson_id, title, page, dense_rank() OVER (PARTITION BY lesson_id ORDER BY page, page_id) AS place FROM ocr_pages WHERE lesson_id IS NOT NULL AND title IS NOT NULL)
SELECT lesson_id AS source, place::INTEGER AS page, 1::INTEGER AS lesson FROM p""")  # fmt: skip
def scan_books(pages):
    """Pages of scans put into lessons: each source here is one lesson, its title on the first page and every third."""
    from lexiloom.operators.ranking import numbered

    own = pages.filter("lesson_id is not null and title is not null").select("page_id", "lesson_id", "title", "page")
    n = numbered(own, ["lesson_id"], ["page", "page_id"], "place")
    p = n.select(F.col("lesson_id").alias("source"), F.col("place").alias("page"), F.when(F.col("place") % 3 == 1, F.col("title")).alias("title"), (F.col("place") + 2).alias("number"), F.lit("Text.").alias("body"), F.lit("text").alias("raw"))
    return layout.scan_lessons(p).select("source", "page", "lesson")


@query("page_records", sql=f"""
WITH {_WORDS}, {_SIZES}, kept AS (SELECT w.* FROM w JOIN sizes USING (doc) WHERE regexp_matches(font, 'Body') AND abs(size - value) <= 0.75 AND l < 40), t AS (SELECT doc, page, string_agg(text, ' ' ORDER BY l, i) AS x FROM kept GROUP BY 1, 2)
SELECT doc, page::INTEGER AS page, len(string_split(x, ' '))::INTEGER AS words FROM t""")  # fmt: skip
def body_texts(records):
    """The words of the body text of each page, by its family and size."""
    w = _words(records)
    sizes = layout.dominant_size(w)
    placed = w.filter("l < 40").withColumns({"x0": F.col("i") * 40.0, "x1": F.col("i") * 40.0 + 35, "top": F.col("l") * 14.0, "bottom": F.col("l") * 14.0 + 10})
    body = layout.body_words(placed, sizes, sizes.select("doc", F.lit("body").alias("value")))
    return body.groupBy("doc", "page").agg(F.count(F.lit(1)).cast("int").alias("words")).withColumn("page", F.col("page").cast("int"))
