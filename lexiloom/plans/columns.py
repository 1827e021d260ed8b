"""Queries of the column functions: paths, words, keys, numbers, times, arrays and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import numeric as N
from lexiloom.functions import text as X
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


_STEM = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_PATHS = """SELECT p_partkey, '/books/' || CASE p_partkey % 3 WHEN 0 THEN chr((65 + p_partkey % 26)::INTEGER) || '级' WHEN 1 THEN chr((65 + p_partkey % 26)::INTEGER) || ' shelf' ELSE '9 mixed' END || '/' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE chr((65 + p_partkey % 26)::INTEGER) END
  || CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '' END || (p_partkey % 70) || CASE p_partkey % 3 WHEN 0 THEN ' - ' ELSE ' ' END || p_name || CASE p_partkey % 4 WHEN 1 THEN '_raz_' || lower(p_type) || '_clr' WHEN 2 THEN ' S书本' ELSE '' END || '.v1.pdf' AS path FROM part"""


def _paths(part):
    k, letter = F.col("p_partkey"), F.char(65 + F.col("p_partkey") % 26)
    folder = F.when(k % 3 == 0, F.concat(letter, F.lit("级"))).when(k % 3 == 1, F.concat(letter, F.lit(" shelf"))).otherwise("9 mixed")
    end = F.when(k % 4 == 1, F.concat(F.lit("_raz_"), F.lower("p_type"), F.lit("_clr"))).when(k % 4 == 2, " S书本").otherwise("")
    path = F.concat(F.lit("/books/"), folder, F.lit("/"), F.when(k % 5 == 0, "").otherwise(letter), F.when(k % 4 == 0, " ").when(k % 4 == 1, "-").otherwise(""), (k % 70).cast("string"), F.when(k % 3 == 0, " - ").otherwise(" "), F.col("p_name"), end, F.lit(".v1.pdf"))
    return part.select("p_partkey", path.alias("path"))


@query("part", sql=f"""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '(?i)^[A-Z][ -]?[0-9]+[ -]*', ''), '(?i)[- ]*raz_[a-z0-9_]+?(?:_clr)?$', ''), '(?i)[- ]*S?书本$', '').replace('书本', ''), '\\s+', ' ', 'g'), '^[ _-]+|[ _-]+$', '', 'g') AS title,
  regexp_replace(regexp_replace(regexp_replace(trim(nfc_normalize(stem)), '(?i)^[A-Z]\\s*[-_ ]\\s*[0-9]{{1,4}}\\s*[-_. ]*', ''), '^[0-9]{{1,4}}\\s*[-_. ]*', ''), '^[ ._-]+|[ ._-]+$', '', 'g') AS audio,
  coalesce(nullif(folder, ''), nullif(regexp_extract(upper(path), '/([A-Z])[^/]*$', 1), ''), '?') AS parent, nullif(upper(regexp_extract(path, '(?i)/([A-Z])级', 1)), '') AS marker, coalesce(nullif(folder, ''), '?') AS folder,
  try_cast(nullif(regexp_extract(upper(stem), '^[A-Z][ -]?([0-9]+)', 1), '') AS INTEGER) AS number
FROM (SELECT p_partkey, path, {_STEM.format('path')} AS stem, regexp_extract(upper(path), '/([A-Z])[^/]*/[^/]*$', 1) AS folder FROM ({_PATHS}))""")  # fmt: skip
def file_names(part):
    """Titles, levels and numbers out of paths, in all variants."""
    p = F.col("path")
    return _paths(part).select("p_partkey", X.clean_file_title(p).alias("title"), X.audio_title(p).alias("audio"), X.level_from_parent(p).alias("parent"), X.level_from_marker(p).alias("marker"), X.level_from_folder(p).alias("folder"), X.source_number(p).alias("number"))


@query("course_library", sql=f"""
SELECT row_id, {_line('nfc_normalize(title)')} AS line, regexp_replace(lower(font[strpos(font, '+') + 1:]), '(?is)-(?:bold|italic|roman|regular|medium|semibold|cn).*', '') AS family, len(w) > 0 AND len(list_filter(w, lambda x: NOT (list_contains(['a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with'], lower(x)) OR regexp_matches(x, '^\\p{{Lu}}')))) = 0 AS title_like
FROM (SELECT row_id, title, 'AB12CD+' || coalesce(source_name, 'none') || CASE row_id % 3 WHEN 0 THEN '-BoldItalic' WHEN 1 THEN '-Roman' ELSE '' END AS font, regexp_extract_all(title, '[A-Za-z0-9]+(?:[’''][A-Za-z]+)*(?:-[A-Za-z0-9]+)*') AS w FROM course_library WHERE title IS NOT NULL)""".replace("regexp_replace(lower(font[strpos", "regexp_replace(regexp_replace(lower(font[strpos").replace("|cn).*', '') AS family", "|cn).*', ''), '[^a-z0-9]', '', 'g') AS family"))  # fmt: skip
def title_forms(lib):
    """Composed lines, font families, lines that look like titles."""
    font = F.concat(F.lit("AB12CD+"), F.coalesce("source_name", F.lit("none")), F.when(F.col("row_id") % 3 == 0, "-BoldItalic").when(F.col("row_id") % 3 == 1, "-Roman").otherwise(""))
    return lib.filter("title is not null").select("row_id", X.normalize_line(F.col("title")).alias("line"), X.font_family(font).alias("family"), X.is_title_like(F.col("title")).alias("title_like"))


@query("course_library", sql=f"""
WITH d AS (SELECT row_id, CASE row_id % 3 WHEN 0 THEN replace(title, ' ', '.') || '...' || title || '.' WHEN 1 THEN '...' || replace(title, ' ', '.') || '.”' ELSE title || ' 3.5' END AS x FROM course_library WHERE title IS NOT NULL AND NOT contains(title, chr(10))),
e AS (SELECT *, len(list_filter(generate_series(2, length(x) - 1), lambda i: x[i] = '.' AND regexp_matches(x[i - 1], '[A-Za-zÀ-ÿ,;:]') AND regexp_matches(x[i + 1], '[A-Za-zÀ-ÿ“‘]'))) >= 2 AS encoded FROM d),
s AS (SELECT *, {_line("replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^[.]{3,}', ''), '[.]([”’\"''])', chr(57347) || '\\1', 'g'), '[.]{2,}\\s*([A-ZÀ-Þ“‘\"''])', chr(57346) || '\\1', 'g'), '[.]{2,}', ' ', 'g'), '.', ' '), chr(57346), '. '), chr(57347), '.')")} AS y FROM e)
SELECT row_id, CASE WHEN encoded THEN CASE WHEN x[-1] = '.' AND NOT regexp_matches(y, '[.!?][\"''’”)]*$') THEN y || '.' ELSE y END ELSE x END AS repaired FROM s""")  # fmt: skip
def dotted_spacing(lib):
    """Titles with full stops in place of blanks, put right; others stay as they are."""
    t, k, dots = F.col("title"), F.col("row_id") % 3, F.replace("title", F.lit(" "), F.lit("."))
    x = F.when(k == 0, F.concat(dots, F.lit("..."), t, F.lit("."))).when(k == 1, F.concat(F.lit("..."), dots, F.lit(".”"))).otherwise(F.concat(t, F.lit(" 3.5")))
    return lib.filter("title is not null and not contains(title, '\n')").select("row_id", X.repair_dotted_spacing(x).alias("repaired"))


@query("students", "sessions", sql="""
SELECT s.token, lower(trim(u.shown)) AS name, s.token AS cookie, right(s.token, 20) AS tail, replace(replace(rtrim(base64(encode(s.token)), '='), '+', '-'), '/', '_') AS url, length(u.shown) BETWEEN 2 AND 12 AS name_fits, CASE WHEN length(s.user_id) BETWEEN 6 AND 30 THEN true ELSE false END AS id_fits
FROM sessions s JOIN (SELECT id, '  ' || upper(min(username)) || ' ' AS shown FROM students GROUP BY id) u ON u.id = s.user_id""")  # fmt: skip
def account_texts(students, sessions):
    """User names, cookies, tails, URL-safe base64 and bounds of lengths."""
    u = students.groupBy("id").agg(F.concat(F.lit("  "), F.upper(F.min("username")), F.lit(" ")).alias("shown"))
    j = sessions.join(u, F.col("id") == F.col("user_id"))
    header = F.concat(F.lit("theme=dark; session="), F.col("token"), F.lit("; x=1"))
    return j.select(
        "token", X.normalize_username(F.col("shown")).alias("name"), X.cookie(header, "session").alias("cookie"), X.tail(F.col("token"), 20).alias("tail"), X.base64url(F.encode("token", "utf-8")).alias("url"),
        N.within(F.col("shown"), 2, 12).alias("name_fits"), N.within(F.col("user_id"), 6, 30).alias("id_fits"),
    )


@query("student_learning_state", "students", "documents", sql="""
SELECT 'state' AS kind, count(*)::BIGINT AS n FROM student_learning_state WHERE length(state_json) > 500 UNION ALL SELECT 'user name', count(*) FROM students WHERE coalesce(length(trim(username)), 0) NOT BETWEEN 2 AND 24
UNION ALL SELECT 'display name', count(*) FROM students WHERE coalesce(length(trim(display_name)), 0) NOT BETWEEN 1 AND 6 UNION ALL SELECT 'speech', count(*) FROM documents WHERE coalesce(length(text), 0) NOT BETWEEN 1 AND 1500""")  # fmt: skip
def length_bounds(states, students, documents):
    """How many values lie outside the bounds of their lengths."""
    out = [(states, "state", F.length("state_json") > 500), (students, "user name", ~N.within(F.trim("username"), 2, 24)), (students, "display name", ~N.within(F.trim("display_name"), 1, 6)), (documents, "speech", ~N.within(F.col("text"), 1, 1500))]
    every = None
    for df, kind, bad in out:
        one = df.agg(F.count_if(bad).alias("n")).select(F.lit(kind).alias("kind"), "n")
        every = one if every is None else every.unionByName(one)
    return every


@query("lineitem", sql="""
SELECT l_orderkey, l_partkey, l_linenumber, 100 - (q + 5) AS left_x, 100 - q AS right_x, reverse(l_returnflag || '-' || l_linenumber) AS turned, CASE WHEN (e % 1000 + (e + 40) % 1000) / 2 < 500 THEN 0 ELSE 2 END + CASE WHEN (q * 20 + q * 20 + 30) / 2 < 500 THEN 0 ELSE 1 END AS quadrant,
  round(q + l_tax * 2 / 4, 6) AS part_start, round(q + l_tax * 3 / 4, 6) AS part_end, greatest(0.0, q - 1.5) AS pad_start, least(50.0, q + 1.5) AS pad_end, greatest(5.0, least(q, 40.0)) AS clamped, round_even(q / 4, 0) AS even, strftime(l_shipdate, '%Y-%-m-%-d') AS day, l_shipdate::DATE AS back
FROM (SELECT *, l_quantity AS q, floor(l_extendedprice)::BIGINT AS e FROM lineitem)""")  # fmt: skip
def geometry(lineitem):
    """Half turns, quadrants, parts of intervals, padding, clamps, rounding, day keys."""
    q, e = F.col("l_quantity"), F.floor("l_extendedprice")
    left, right = N.flipped(q, q + 5, 100)
    a, b = N.subdivided(q, q + F.col("l_tax"), F.lit(4), F.lit(2))
    s, t = N.padded(q, q, 1.5, 1.5, F.lit(50.0))
    day = N.day_key(F.col("l_shipdate"))
    return lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", left.alias("left_x"), right.alias("right_x"), N.turned(F.concat_ws("-", "l_returnflag", "l_linenumber")).alias("turned"), N.quadrant(q * 20, e % 1000, q * 20 + 30, (e + 40) % 1000).alias("quadrant"),
        F.round(a, 6).alias("part_start"), F.round(b, 6).alias("part_end"), s.alias("pad_start"), t.alias("pad_end"), N.clamp(q, 5.0, 40.0).alias("clamped"), N.half_even(q / 4).alias("even"), day.alias("day"), N.day_of(day).alias("back"),
    )


@query("part", sql="""
SELECT p_partkey, array_to_string(list_distinct_in_order, ',') AS once, array_to_string(w[:1] || ['new', 'old'] || w[3:], ',') AS spliced, array_to_string(list_transform(w, lambda x: CASE WHEN x = w[1] THEN x || '!' ELSE x END), ',') AS updated,
  array_to_string(CASE WHEN list_contains(w, 'gear') THEN w ELSE w || ['gear'] END, ',') AS added, 'a=' || p_size || ',b=0,c=' || p_partkey AS merged, 'b=0,c=' || p_partkey AS popped, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, -1) AS got
FROM (SELECT *, CASE WHEN a = b THEN [a, 'x'] ELSE [a, b, 'x'] END AS list_distinct_in_order, [a, b] AS w FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part))""")  # fmt: skip
def collections(part):
    """Arrays and maps: distinct in order, spliced, updated, added once; merged, without a key, sorted."""
    w = F.split("p_name", " ")
    show = lambda m: F.array_join(F.transform(F.map_entries(N.sorted_map(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    old = F.create_map(F.lit("b"), F.col("p_size").cast("string"), F.lit("a"), F.col("p_size").cast("string"))
    new = F.create_map(F.lit("c"), F.col("p_partkey").cast("string"), F.lit("b"), F.lit("0"))
    merged = N.merged_map(old, new)
    sizes = F.map_filter(F.create_map(F.lit("n"), F.col("p_size")), lambda _, v: v % 2 == 0)
    join = lambda a: F.array_join(a, ",")
    return part.select(
        "p_partkey", join(N.distinct_in_order(F.concat(w, F.array(F.lit("x")), w))).alias("once"), join(N.spliced(w, F.lit(2), F.array(F.lit("new"), F.lit("old")))).alias("spliced"), join(N.updated_where(w, lambda x: x == F.get(w, F.lit(0)), lambda x: F.concat(x, F.lit("!")))).alias("updated"),
        join(N.added_once(w, F.lit("gear"), lambda x: x == "gear")).alias("added"), show(merged).alias("merged"), show(N.taken_out(merged, F.lit("a"))).alias("popped"), F.coalesce(F.try_element_at(sizes, F.lit("n")), F.lit(-1)).cast("bigint").alias("got"),
    )


@query("sentences", sql=f"""
WITH t AS (SELECT row_id, list_filter(list_transform(regexp_extract_all(english, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> '') AS w FROM sentences WHERE english IS NOT NULL)
SELECT row_id, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '[0-9]|1[0-9]|20') THEN ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen', 'twenty'][x::INTEGER + 1] ELSE x END), ' ') AS words FROM t""")  # fmt: skip
def transcript_tokens(sentences):
    """Words as an alignment compares them: small letters, numbers up to twenty written out."""
    return sentences.filter("english is not null").select("row_id", F.array_join(X.transcript_words(F.col("english")), " ").alias("words"))


@query("ocr_pages", sql=f"""
WITH p AS (SELECT page_id, {_line("regexp_replace(title, '[<>\\[\\]|`]', '', 'g')")} AS t FROM ocr_pages WHERE title IS NOT NULL)
SELECT page_id, CASE page_id % 4 WHEN 1 THEN '' ELSE t END AS said, 'end x' AS cleaned FROM p""")  # fmt: skip
def model_answers(pages):
    """Answers of speech and page models with their wrappers, and what is left without them."""
    t = X.normalize_line(F.regexp_replace("title", r"[<>\[\]|`]", ""), compose=False)
    p = pages.filter("title is not null").select("page_id", t.alias("t"))
    k, t = F.col("page_id") % 4, F.col("t")
    asr = F.when(k == 0, F.concat(F.lit("language English<asr_text> "), t)).when(k == 1, F.lit("language None<asr_text> ")).when(k == 2, F.concat(F.lit("language None<ASR_TEXT>"), t)).otherwise(t)
    answer = F.concat(F.lit("```text\nMain story text: "), t, F.lit(" end [Non-Text] || x\n```"))
    return p.select("page_id", X.parse_asr_output(asr).alias("said"), X.clean_transcription(answer, t).alias("cleaned"))


@query("ocr_pages", sql=f"""
WITH p AS (SELECT page_id, {_line("regexp_replace(title, '\\s+', ' ', 'g')")} AS t FROM ocr_pages WHERE title IS NOT NULL)
SELECT page_id, q AS quadrant, CASE q WHEN 0 THEN 'first line ' || t WHEN 1 THEN t ELSE t || ' next line' END AS text FROM p CROSS JOIN (SELECT unnest([0, 1, 3]) AS q)""")  # fmt: skip
def sheet_blocks(pages):
    """Text blocks of contact sheets put into their quadrants from top to bottom; pictures and page numbers go."""
    from lexiloom.operators import votes

    t = X.normalize_line(F.regexp_replace("title", r"(?U)\s+", " "), compose=False)
    p = pages.filter("title is not null").select("page_id", t.alias("t"))
    raw = F.concat(
        F.lit("text [100, 200, 400, 300] "), F.col("t"), F.lit("\ntext [100, 50, 400, 90] first\n line\nimage [0, 0, 499, 499] picture\ntext [600,100,900,200] "), F.col("t"),
        F.lit("\ntext [100, 600, 400, 700] 12\ntext [700, 600, 900, 700] "), F.col("t"), F.lit("\ntext [700, 800, 900, 900] next line\ntext [1, 2, 3] broken"),
    )
    return votes.sheet_texts(p.select("page_id", raw.alias("raw"))).select("page_id", "quadrant", "text")
