"""Queries over the supplied tables, one or more for each family of operators, with the same in SQL where SQL can say it.

Every query runs over whole tables. In the SQL, list functions and the JSON functions of DuckDB are used.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import fuzzy
from lexiloom.functions import numeric as N
from lexiloom.functions import text as X
from lexiloom.operators import align, catalog, layout, learner, library, nested, quality, ranking, rejects, shards, votes
from lexiloom.session import join_small, scratch, table
from lexiloom.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}
_BLANK = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: The instant at which sessions are looked at, and the day at which streaks end.
NOW, TODAY = 1_754_000_000, "2024-01-30"


def query(*names: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(*[table(spark, d, n) for n in names])
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def streamed(spark, d: str, name: str):
    """A table as a stream of its files; zone-less times become UTC timestamps."""
    whole = f"{d}/{name}.parquet"
    folder, schema = readers.is_folder(spark, whole), spark.read.parquet(whole).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder else f"{name}.parquet").option("maxFilesPerTrigger", 8).parquet(whole if folder else d)
    ntz = [f.name for f in schema if f.dataType.simpleString() == "timestamp_ntz"]
    return source.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else source


# Text and sentences ---------------------------------------------------------------------------------------------------

def _line(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({x}, chr(173), ''), chr(65533), '.'), '{_BLANK}+', ' ', 'g'), ' +([,.;:!?])', '\\1', 'g'), '([“‘]) +', '\\1', 'g'), ' +([”’])', '\\1', 'g'))"


_MARKS = "[.!?]+[\"''’”)]*"


def _cut(x: str) -> str:
    """A mark behind each end of a sentence: before a blank, before the next letter, at the end. Twice, as matches take the next character."""
    for _ in range(2):
        x = f"regexp_replace({x}, '({_MARKS})({_BLANK}+)([^\\s,;:\\p{{Ll}}\\x{{0001}}\\x{{0002}}])', '\\1' || chr(1) || '\\2\\3', 'g')"
        x = f"regexp_replace({x}, '({_MARKS})([^\\s,;:\\p{{Ll}}.!?\"''’”)\\x{{0001}}\\x{{0002}}])', '\\1' || chr(1) || '\\2', 'g')"
    return f"regexp_replace({x}, '({_MARKS})({_BLANK}*)\\x{{0002}}', '\\1' || chr(1) || '\\2', 'g')"


_DOT = "chr(57344)"


def _protected(x: str) -> str:
    """Full stops of abbreviations, rows of initials and decimals as a stand-in; each pass takes the next one of a row."""
    for a in X.ABBREVIATIONS:
        x = f"replace({x}, '{a}', replace('{a}', '.', {_DOT}))"
    for _ in range(6):
        x = f"regexp_replace({x}, '\\b([A-Z])[.](\\s*(?:[A-Z][.]\\s*)+[A-Z][a-z])', '\\1' || {_DOT} || '\\2', 'g')"
    x = f"regexp_replace({x}, '(\\x{{E000}}\\s*[A-Z])[.](\\s*[A-Z][a-z])', '\\1' || {_DOT} || '\\2', 'g')"
    for _ in range(6):
        x = f"regexp_replace({x}, '\\b([A-Z])[.]([A-Z][.])', '\\1' || {_DOT} || '\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([0-9])[.]([0-9])', '\\1' || {_DOT} || '\\2', 'g')"
    return x


_SPLIT = f"list_filter(list_transform(list_reverse(list_reverse(string_split({_cut(_protected('text') + ' || chr(2)')}, chr(1)))[2:]), lambda x: {_line(f"replace(x, {_DOT}, '.')")}), lambda x: regexp_matches(x, '[A-Za-z0-9]'))"
_WORD_SQL = "[A-Za-z0-9]+(?:[’''][A-Za-z]+)*(?:-[A-Za-z0-9]+)*"


@query("documents", sql=f"""
SELECT source, count(*)::BIGINT AS documents, sum(len(s))::BIGINT AS sentences, sum(len(regexp_extract_all(array_to_string(s, ' '), '{_WORD_SQL}')))::BIGINT AS words,
  count(*) FILTER (WHERE len(s) = 0)::BIGINT AS without_sentence
FROM (SELECT source, {_SPLIT} AS s FROM documents WHERE text IS NOT NULL) GROUP BY source""")  # fmt: skip
def sentence_qa_summary(documents):
    s = documents.filter("text is not null").select("source", X.split_sentences(F.col("text")).alias("s"))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("s")).alias("sentences"), F.sum(X.count_words(F.array_join("s", " "))).alias("words"), F.count_if(F.size("s") == 0).alias("without_sentence"))


@query("documents", sql=f"""
SELECT doc_id, i::BIGINT AS seq, s[i] AS sentence, 'D' || doc_id || '-S' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INTEGER, '0') AS sentence_id
FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT doc_id, {_SPLIT} AS s FROM documents WHERE text IS NOT NULL))""")  # fmt: skip
def sentence_split(documents):
    s = documents.filter("text is not null").select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("i", "sentence"))
    seq = (F.col("i") + 1).cast("bigint")
    return s.select("doc_id", seq.alias("seq"), "sentence", X.sentence_id(F.concat(F.lit("D"), F.col("doc_id")), seq).alias("sentence_id"))


@query("documents", sql=f"""
SELECT coalesce(level, '?') AS level, count(*)::BIGINT AS documents, sum(len(regexp_extract_all(text, '{_WORD_SQL}')))::BIGINT AS words,
  count(*) FILTER (WHERE regexp_matches(text, '[.!?]["''’”)]*$'))::BIGINT AS with_final_mark
FROM documents WHERE text IS NOT NULL GROUP BY 1""")  # fmt: skip
def word_counts_by_level(documents):
    t = documents.filter("text is not null")
    return t.groupBy(F.coalesce("level", F.lit("?")).alias("level")).agg(F.count(F.lit(1)).alias("documents"), F.sum(X.count_words(F.col("text"))).cast("bigint").alias("words"), F.count_if(X.has_final_mark(F.col("text"))).alias("with_final_mark"))


@query("sentences", sql="""
SELECT row_id, len(w)::INTEGER AS n_words, array_to_string(w, '|') AS words, regexp_replace(array_to_string(w, '|'), '[^A-Za-z]', '', 'g') AS letters
FROM (SELECT row_id, regexp_extract_all(english, '[A-Za-z]+(?:[.''’‑-][A-Za-z]+)*') AS w FROM sentences WHERE english IS NOT NULL)""")  # fmt: skip
def dictation_tokens(sentences):
    w = X.words(F.col("english"), X.DICTATION_WORD)
    joined = F.array_join(w, "|")
    return sentences.filter("english is not null").select("row_id", F.size(w).alias("n_words"), joined.alias("words"), X.letters_only(joined).alias("letters"))


@query("sentences", sql=f"""SELECT row_id, regexp_replace(english, '{_BLANK}', '', 'g') AS solid FROM sentences WHERE english IS NOT NULL""")
def dictation_round_trip(sentences):
    """Words with what stands around them give the sentence back, but for its blanks."""
    parts = F.transform(X.dictation_words(F.col("english")), lambda x: F.concat(x["before"], x["word"], x["after"]))
    solid = F.when(F.size(parts) > 0, F.array_join(parts, "")).otherwise(F.regexp_replace("english", r"(?U)\s", ""))  # no word to hang on
    return sentences.filter("english is not null").select("row_id", solid.alias("solid"))


@query("part", sql="""
SELECT p_partkey, regexp_replace(p_name, '[A-Za-z]', '-', 'g') AS dashes, left(p_name, 1) || repeat('-', greatest(length(p_name) - 1, 0)) AS masked, sha1(p_name)[1:12] AS short_hash,
  sha256(p_name || chr(0) || p_type) AS cache_key FROM part""")  # fmt: skip
def word_hints(part):
    return part.select("p_partkey", X.dash_hint(F.col("p_name")).alias("dashes"), X.masked_hint(F.col("p_name")).alias("masked"), X.short_hash(F.col("p_name")).alias("short_hash"), X.cache_key(F.col("p_name"), F.col("p_type")).alias("cache_key"))


@query("course_library", sql=f"""
SELECT row_id, {_line('nfc_normalize(title)')} AS line, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_key, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS vote_key,
  coalesce(try_cast(nullif(regexp_extract(id, '([0-9]+)$', 1), '') AS BIGINT), 9999) AS number, upper(level) || ':' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS order_key
FROM course_library WHERE title IS NOT NULL""")  # fmt: skip
def title_keys(lib):
    t, key = F.col("title"), X.title_key(F.col("title"))
    return lib.filter("title is not null").select("row_id", X.normalize_line(t).alias("line"), key.alias("title_key"), X.vote_key(t).alias("vote_key"), X.trailing_number(F.col("id")).alias("number"), F.concat_ws(":", F.upper("level"), key).alias("order_key"))


@query("page_records", sql="""
SELECT page_id, coalesce(nullif(regexp_extract(upper(source_name), '^([A-Z])', 1), ''), '?') AS initial, regexp_replace(source_name, '\\.[^.]*$', '') AS stem,
  coalesce(try_cast(nullif(regexp_extract(regexp_replace(source_name, '\\.[^.]*$', ''), '([0-9]+)$', 1), '') AS BIGINT), 9999) AS number, split_part(lesson_id, '-', 2) AS level, split_part(lesson_id, '-', -1) AS last_part
FROM page_records WHERE source_name IS NOT NULL""")  # fmt: skip
def level_path_parse(records):
    s = F.col("source_name")
    return records.filter("source_name is not null").select("page_id", X.level_from_parent(s).alias("initial"), X.file_stem(s).alias("stem"), X.trailing_number(X.file_stem(s)).alias("number"), X.id_part(F.col("lesson_id"), 2).alias("level"), X.id_part(F.col("lesson_id"), -1).alias("last_part"))


_HAS = "list_bool_or(list_transform([{}], lambda p: contains(lower({}), p)))"
_QUOTED = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


@query("documents", sql=f"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN text = '' THEN 'empty' END, CASE WHEN {_HAS.format(_QUOTED(X.ARTIFACTS), 'text')} THEN 'artifact_text' END,
  CASE WHEN NOT regexp_matches(text, '[.!?]["''’”)]*$') THEN 'missing_terminal_punctuation' END, CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-’''][A-Za-z0-9]+)*')) > 70 THEN 'very_long_sentence' END,
  CASE WHEN (length(text) - length(replace(text, '"', ''))) % 2 = 1 THEN 'unbalanced_straight_quotes' END, CASE WHEN n_chars IS DISTINCT FROM length(text) THEN 'stale_length' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def qa_reasons(documents):
    t = F.col("text")
    found = N.reasons(
        (t == "", "empty"), (X.contains_any(t, X.ARTIFACTS), "artifact_text"), (~X.has_final_mark(t), "missing_terminal_punctuation"), (X.count_words(t, X.BUILDER_WORD) > 70, "very_long_sentence"),
        (X.odd_quotes(t), "unbalanced_straight_quotes"), (~F.col("n_chars").eqNullSafe(F.length(t).cast("bigint")), "stale_length"),
    )
    return documents.filter("text is not null").select("doc_id", F.array_join(found, ",").alias("reasons"))


@query("ocr_pages", sql=f"""
SELECT page_id, used = 'vision_fallback' OR {_HAS.format(_QUOTED(X.DISPUTE_ARTIFACTS), 'u')} OR (u <> '' AND starts_with(lower(u), lower(coalesce(title, '')) || ' '))
  OR (length(p) - length(replace(p, '"', ''))) % 2 = 1 AS disputed
FROM (SELECT *, CASE WHEN used = 'unlimited_ocr' THEN u ELSE v END AS p FROM (SELECT page_id, title, used, coalesce(vision, '') AS v, coalesce(unlimited, '') AS u FROM ocr_pages)) WHERE used IS NOT NULL""")  # fmt: skip
def disputed_pages(pages):
    return pages.filter("used is not null").select("page_id", X.is_disputed(F.coalesce("title", F.lit("")), F.coalesce("vision", F.lit("")), F.coalesce("unlimited", F.lit("")), F.col("used")).alias("disputed"))


@query("ocr_pages", sql=f"""
SELECT page_id, CASE WHEN coalesce(unlimited, '') = '' THEN false WHEN v = '' THEN true END AS second_taken, CASE WHEN coalesce(unlimited, '') = '' THEN length(v) WHEN v = '' THEN length(unlimited) END AS n_chars, coalesce(unlimited, '') <> '' AND v <> '' AS compared
FROM (SELECT page_id, unlimited, {_line("nfc_normalize(coalesce(vision, ''))")} AS v FROM ocr_pages)""")
def ocr_vote_empty(pages):
    """Which reading is taken where one of the two is empty."""
    v = votes.two_way(pages.select("page_id", "vision", "unlimited"))
    compared = (F.coalesce("unlimited", F.lit("")) != "") & (X.normalize_line(F.coalesce("vision", F.lit(""))) != "")
    return v.select("page_id", F.when(~compared, F.col("used") == "unlimited_ocr").alias("second_taken"), F.when(~compared, F.length("selected")).cast("bigint").alias("n_chars"), compared.alias("compared"))


@query("ocr_pages")
def ocr_vote(pages):
    """Two readings: which is taken, and how far they agree."""
    v = votes.two_way(pages.select("page_id", "vision", "unlimited"))
    return v.select("page_id", "similarity", "used", F.length("selected").alias("n_chars"))


@query("ocr_pages")
def ocr_vote_three(pages):
    """Three readings; the third stands in for the missing one where a page was delivered again."""
    third = pages.groupBy("lesson_id", "page").agg(F.max_by("unlimited", "page_id").alias("candidate"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    p = pages.select("page_id", "lesson_id", "page", "title", "vision", "unlimited", "used").filter("used is not null").join(third, ["lesson_id", "page"], "left")
    return votes.three_way(p).select("page_id", "by", F.array_join("reasons", ",").alias("reasons"), F.length("chosen").alias("n_chars"))


@query("ocr_pages", sql=f"""
WITH p AS (SELECT page_id, lesson_id, page, {_line('unlimited')} AS piece FROM ocr_pages WHERE unlimited IS NOT NULL)
SELECT page_id, piece, (sum(length(piece) + 1) OVER (PARTITION BY lesson_id ORDER BY page, page_id) - length(piece) - 1)::BIGINT AS begin FROM p WHERE piece <> ''""")  # fmt: skip
def lesson_pieces(pages):
    return votes.lesson_pieces(pages, "lesson_id", ["page", "page_id"], "unlimited").select("page_id", "piece", "begin")


# Library --------------------------------------------------------------------------------------------------------------


@query("course_library", sql="""
SELECT id, source_name, title, level, row_id, first_row FROM (SELECT id, coalesce(source_name, '') AS source_name, title, level, row_id, min(row_id) OVER w AS first_row,
  row_number() OVER (PARTITION BY id, coalesce(source_name, '') ORDER BY row_id DESC) AS n FROM course_library WINDOW w AS (PARTITION BY id, coalesce(source_name, ''))) WHERE n = 1""")  # fmt: skip
def keep_last_dedupe(lib):
    d = library.deduplicated(lib.select("id", "source_name", "title", "level", "row_id"))
    return d.select("id", "source_name", "title", "level", "row_id", F.col("first_place.row_id").alias("first_row"))


@query("course_library", sql="""SELECT row_id, id, count(*) OVER (PARTITION BY id) > 1 AS duplicated FROM course_library""")
def duplicate_flags(lib):
    counts = lib.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("duplicated"))
    return join_small(lib.select("row_id", "id"), counts, "id")


_JSON_LIST = "CASE WHEN json_valid(sentences_json) THEN CASE WHEN json_type(sentences_json) = 'ARRAY' THEN sentences_json::JSON ELSE json_extract(sentences_json, '$.sentences') END END"


@query("course_library", sql="""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY id, coalesce(source_name, '') ORDER BY row_id DESC) AS n, min(row_id) OVER (PARTITION BY id, coalesce(source_name, '')) AS f FROM course_library),
s AS (SELECT *, count(*) OVER (PARTITION BY id) > 1 AS dup FROM k WHERE n = 1),
g AS (SELECT *, upper(level) AS l, coalesce(try_cast(nullif(regexp_extract(id, '([0-9]+)$', 1), '') AS BIGINT), 9999) AS num FROM s WHERE regexp_matches(upper(level), '^[A-Z]$')),
r AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY num, coalesce(source_name, ''), coalesce(title, ''), f) AS i FROM g)
SELECT 'RAZ-' || l || '-' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INTEGER, '0') AS id, id AS source_lesson_id, dup AS source_id_duplicated, l AS level, coalesce(title, '') AS title, coalesce(source_name, '') AS source_name FROM r""")  # fmt: skip
def library_build(lib):
    lessons = lib.withColumn("sentences", library.parsed_sentences(F.col("sentences_json")))
    return library.built(lessons).select("id", "source_lesson_id", "source_id_duplicated", "level", "title", "source_name")


@query("course_library")
def library_review(lib):
    """Review reasons and counts of the built library."""
    lessons = lib.withColumn("sentences", library.parsed_sentences(F.col("sentences_json")))
    return library.built(lessons).select("id", "status", F.array_join("reasons", ",").alias("reasons"), "sentence_count", "word_count")


@query("course_library", sql=f"""
WITH s AS (SELECT row_id, sentences_json, {_JSON_LIST} AS j FROM course_library WHERE sentences_json IS NOT NULL)
SELECT row_id, json_array_length(j)::INTEGER AS n FROM s WHERE j IS NOT NULL""")
def polymorphic_lessons(lib):
    """Sentence lists of both outer shapes; unreadable documents are left out."""
    rows = lib.filter("sentences_json is not null and try_parse_json(sentences_json) is not null")
    n = F.coalesce(F.expr("json_array_length(case when startswith(ltrim(sentences_json), '[') then sentences_json else get_json_object(sentences_json, '$.sentences') end)"), F.lit(None).cast("int"))
    return rows.select("row_id", n.alias("n")).filter("n is not null")


@query("course_library", sql="""
WITH s AS (SELECT row_id, id, level, title, CASE WHEN json_valid(sentences_json) THEN CASE WHEN json_type(sentences_json) = 'ARRAY' THEN sentences_json::JSON ELSE json_extract(sentences_json, '$.sentences') END END AS j FROM course_library),
e AS (SELECT *, CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["json"]') END AS l FROM s)
SELECT row_id, p AS problem FROM (SELECT row_id, unnest(list_filter([CASE WHEN coalesce(trim(id), '') = '' THEN 'id' END, CASE WHEN coalesce(trim(level), '') = '' THEN 'level' END, CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(len(l), 0) = 0 THEN 'sentences' END,
  CASE WHEN list_bool_or(list_transform(l, lambda x: coalesce(trim(json_extract_string(x, '$.id')), '') = '' OR coalesce(trim(json_extract_string(x, '$.english')), '') = '')) THEN 'english' END], lambda x: x IS NOT NULL)) AS p FROM e)""")
def import_violations(lib):
    """Everything that a lesson would be refused for, also its sentences."""
    lessons = lib.select("row_id", "id", "level", "title", library.parsed_sentences(F.col("sentences_json")).alias("sentences"))
    return library.violations(lessons, most=10**12, keep=("row_id",)).select("row_id", "problem")


@query("sentences", "course_library")
def corrections_applied(sentences, lib):
    """Each title's first sentence replaced by two, where it occurs exactly once in the lesson."""
    lessons = lib.withColumn("sentences", library.parsed_sentences(F.col("sentences_json"))).filter("size(sentences) > 0 and level is not null and title is not null").select("row_id", "level", "title", "sentences")
    fixes = lessons.groupBy("level", "title").agg(F.min_by(F.col("sentences")[0]["english"], "row_id").alias("replace"))
    fixes = fixes.withColumn("with", F.array(F.concat(F.lit("(1) "), "replace"), F.concat(F.lit("(2) "), "replace")))
    return library.corrected(lessons, fixes).select("row_id", "correction", F.size("sentences").alias("n"))


@query("course_csv")
def csv_lessons(records):
    """Lessons of the records that load, with where they were first met."""
    return readers.csv_lessons(rejects.loaded(records), "row_id")


@query("course_csv")
def csv_lesson_sentences(records):
    """Their sentences, numbered in each lesson."""
    return readers.csv_sentences(rejects.loaded(records), "row_id")


# Joins, sets, orders --------------------------------------------------------------------------------------------------


@query("sessions", "students", sql=f"""
SELECT token, user_id, username, display_name, expires_at FROM sessions JOIN (SELECT id, min(username) AS username, min(display_name) AS display_name FROM students GROUP BY id) ON id = user_id WHERE expires_at > {NOW}""")
def session_join_ttl(sessions, students):
    return learner.active_sessions(sessions, students, F.lit(NOW))


@query("course_library", "ocr_pages", sql="""
SELECT row_id, coalesce(n, 0)::BIGINT AS pages, coalesce(t, '') AS page_title FROM course_library LEFT JOIN (SELECT lesson_id, count(*) AS n, min(title) AS t FROM ocr_pages GROUP BY lesson_id) ON id = lesson_id""")
def pages_left_join(lib, pages):
    p = pages.groupBy(F.col("lesson_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("t"))
    return join_small(lib.select("row_id", "id"), p, "id", "left").select("row_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("pages"), F.coalesce("t", F.lit("")).alias("page_title"))


@query("customer", "orders", sql="""SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_eligible(customer, orders):
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("part", "lineitem", sql="""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)""")
def anti_unused(part, lineitem):
    return part.join(lineitem.filter("l_returnflag = 'R' and l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("course_library", "sentences", "ocr_pages", sql="""
WITH l AS (SELECT DISTINCT id FROM course_library), s AS (SELECT DISTINCT lesson_id AS id FROM sentences WHERE lesson_id IS NOT NULL), o AS (SELECT DISTINCT lesson_id AS id FROM ocr_pages)
SELECT 'in both' AS kind, count(*)::BIGINT AS n FROM (SELECT id FROM l INTERSECT SELECT id FROM s) UNION ALL SELECT 'without sentences', count(*) FROM (SELECT id FROM l EXCEPT SELECT id FROM s)
UNION ALL SELECT 'any', count(*) FROM (SELECT id FROM l UNION SELECT id FROM s UNION SELECT id FROM o) UNION ALL SELECT 'all rows', count(*) FROM (SELECT id FROM course_library UNION ALL SELECT lesson_id FROM sentences)""")  # fmt: skip
def set_operations(lib, sentences, pages):
    a, b, c = lib.select("id").distinct(), sentences.select(F.col("lesson_id").alias("id")).filter("id is not null").distinct(), pages.select(F.col("lesson_id").alias("id")).distinct()
    every = lib.select("id").unionByName(sentences.select(F.col("lesson_id").alias("id")))
    parts = [("in both", a.intersect(b)), ("without sentences", a.subtract(b)), ("any", a.union(b).union(c).distinct()), ("all rows", every)]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("part", sql="SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def order_by_limit(part):
    return part.filter("p_size > 10").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("course_library", sql=f"""
SELECT row_id, list_position([{_QUOTED(X.LEVELS)}], level)::INTEGER AS level_place, row_number() OVER (ORDER BY list_position([{_QUOTED(X.LEVELS)}], level), id, row_id)::BIGINT AS place FROM course_library WHERE list_contains([{_QUOTED(X.LEVELS)}], level)""")
def level_order(lib):
    at = lib.filter(F.col("level").isin(X.LEVELS)).select("row_id", "id", F.array_position(F.lit(X.LEVELS), F.col("level")).cast("int").alias("level_place"))
    return ranking.numbered(at, [], ["level_place", "id", "row_id"], "place").select("row_id", "level_place", "place")


# Catalog --------------------------------------------------------------------------------------------------------------

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
#: The words of a title: full-width letters and ligatures as plain ones, no accents; a title given twice in a row once.
_TOKENS = f"regexp_extract_all(replace(lower(strip_accents(nfc_normalize(replace(replace(replace(replace(translate(title, '{_WIDE[0]}', '{_WIDE[1]}'), chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), 'ſ', 's')))), '&', ' and '), '[a-z0-9]+')"
_ONCE = "CASE WHEN len(w) > 0 AND len(w) % 2 = 0 AND w[:len(w) // 2] = w[len(w) // 2 + 1:] THEN w[:len(w) // 2] ELSE w END"
_SIDES = f"""
lc AS (SELECT DISTINCT block, id, {_ONCE} AS w FROM (SELECT level AS block, id, {_TOKENS} AS w FROM course_library WHERE title IS NOT NULL AND level IS NOT NULL AND id IS NOT NULL) WHERE len(w) > 0),
rc AS (SELECT DISTINCT block, id, {_ONCE} AS w FROM (SELECT split_part(lesson_id, '-', 2) AS block, lesson_id AS id, {_TOKENS} AS w FROM ocr_pages WHERE title IS NOT NULL AND lesson_id IS NOT NULL) WHERE len(w) > 0),
lt AS (SELECT block, w, min(id) || '/' || array_to_string(w, ' ') AS id, count(*) AS copies FROM lc GROUP BY block, w), rt AS (SELECT block, w, min(id) || '/' || array_to_string(w, ' ') AS id, count(*) AS copies FROM rc GROUP BY block, w),
p AS (SELECT lt.block, lt.id AS left_id, rt.id AS right_id, lt.w AS lw, lt.copies AS left_copies, rt.copies AS right_copies, 2 * list_sum(list_transform(list_distinct(list_intersect(lt.w, rt.w)), lambda t: least(len(list_filter(lt.w, lambda x: x = t)), len(list_filter(rt.w, lambda x: x = t)))))
  / (len(lt.w) + len(rt.w)) AS score FROM lt JOIN rt USING (block) WHERE list_has_any(lt.w, rt.w)),
c AS (SELECT * FROM p WHERE score >= 0.8 - 1e-9)"""
#: Copies are each other's seconds; every lesson of a title has a row.
_MARGIN = """
a AS (SELECT *, row_number() OVER (PARTITION BY block, left_id ORDER BY score DESC, right_id) AS n, lead(score) OVER (PARTITION BY block, left_id ORDER BY score DESC, right_id) AS next_score FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY block, right_id ORDER BY score DESC, left_id) AS n, lead(score) OVER (PARTITION BY block, right_id ORDER BY score DESC, left_id) AS next_score FROM c),
z AS (SELECT block, right_id, CASE WHEN left_copies > 1 THEN score ELSE coalesce(next_score, 0) END AS second FROM b WHERE n = 1),
o1 AS (SELECT x.block, x.left_id, x.right_id, x.lw, x.score, least(x.score - CASE WHEN x.right_copies > 1 THEN x.score ELSE coalesce(x.next_score, 0) END, x.score - z.second) AS margin FROM a x JOIN z USING (block, right_id) WHERE x.n = 1),
m AS (SELECT o1.block, lc.id || '/' || array_to_string(lc.w, ' ') AS left_id, right_id, score, margin FROM o1 JOIN lc ON lc.block = o1.block AND lc.w = o1.lw)"""


def _copies(lib, pages):
    """``block, id, copy`` of lessons and of recordings: all that have the words of one title in one level, and who stands for them.

    All titles with a word count, in whatever characters. A lesson delivered twice with the same words is one.
    """

    def side(df):
        words = F.array_join(X.title_tokens(F.col("title")), " ")
        each = df.filter("title is not null").select("level", "id", words.alias("title")).filter("title != ''").distinct()
        one = each.groupBy("level", "title").agg(F.min("id").alias("_one"))
        key = lambda c: F.concat_ws("/", c, "title")
        return each.join(one, ["level", "title"]).select(F.col("level").alias("block"), "title", key("_one").alias("id"), key("id").alias("copy"))

    return side(lib.filter("level is not null and id is not null")), side(pages.filter("lesson_id is not null").select(X.id_part(F.col("lesson_id"), 2).alias("level"), "title", F.col("lesson_id").alias("id")))


def _titles(lib, pages):
    """Distinct titles of both sides by level: copies are one representative, so that no group of copies is expanded."""
    return tuple(c.filter("id = copy").select(F.col("block").alias("level"), "title", "id") for c in _copies(lib, pages))


def _margins(pairs, lib, pages):
    """Margins and a row for every lesson, also those that another one stands for in ``pairs``."""
    return catalog.margins(pairs, *[c.select("block", "id", "copy") for c in _copies(lib, pages)])


@query("course_library", "ocr_pages", sql=f"""
WITH {_SIDES} SELECT 'left' AS side, lt.block, lt.id, lc.id || '/' || array_to_string(lc.w, ' ') AS member FROM lt JOIN lc ON lt.block = lc.block AND lt.w = lc.w
UNION ALL SELECT 'right', rt.block, rt.id, rc.id || '/' || array_to_string(rc.w, ' ') FROM rt JOIN rc ON rt.block = rc.block AND rt.w = rc.w""")  # fmt: skip
def title_members(lib, pages):
    """Which lessons and recordings each id of ``title_candidates`` stands for, itself too."""
    both = [c.select(F.lit(s).alias("side"), "block", "id", F.col("copy").alias("member")) for s, c in zip(("left", "right"), _copies(lib, pages))]
    return both[0].unionByName(both[1])


@query("course_library", "ocr_pages", sql=f"WITH {_SIDES} SELECT block, left_id, right_id, round(score, 6) AS score FROM c")
def title_candidates(lib, pages):
    """One lesson and one recording for each title of a level; ``title_members`` has the others."""
    p = catalog.title_pairs(*_titles(lib, pages))
    return p.withColumn("score", F.round("score", 6))


@query("course_library", "ocr_pages", sql=f"WITH {_SIDES}, {_MARGIN} SELECT block, left_id, right_id, round(score, 6) AS score, round(margin, 6) AS margin FROM m")
def two_ranked_margin(lib, pages):
    m = _margins(catalog.title_pairs(*_titles(lib, pages)), lib, pages)
    return m.select("block", "left_id", "right_id", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query("course_library", "ocr_pages", sql=f"""
WITH {_SIDES}, {_MARGIN}, o AS (SELECT *, score >= 0.9999 OR (score >= 0.84 AND margin >= 0.035) AS ok FROM m),
t AS (SELECT *, coalesce(max(ok::INT) OVER (PARTITION BY right_id ORDER BY score DESC, margin DESC, left_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS taken FROM o)
SELECT block, left_id, right_id, CASE WHEN taken THEN 'audio-already-used' WHEN NOT ok THEN 'ambiguous-or-low-score' ELSE 'mapped' END AS outcome FROM t""")  # fmt: skip
def greedy_assignment(lib, pages):
    return catalog.assigned(_margins(catalog.title_pairs(*_titles(lib, pages)), lib, pages)).select("block", "left_id", "right_id", "outcome")


@query("course_library", "ocr_pages")
def catalog_fuzzy(lib, pages):
    """As ``greedy_assignment``, scored by letters, words and containment."""
    p = catalog.best_pairs(*_titles(lib, pages), least=0.6)
    return catalog.assigned(_margins(p, lib, pages)).withColumn("score", F.round("score", 4)).withColumn("margin", F.round("margin", 4))


@query("part", sql="""
SELECT p_partkey, round(coalesce(2.0 * list_sum(list_transform(list_distinct(list_intersect(a, b)), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0) / (len(a) + len(b)), 6) AS score
FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type || ' ' || p_name || ' ' || p_name), ' ') AS b FROM part)""")  # fmt: skip
def multiset_dice(part):
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat_ws(" ", "p_type", "p_name", "p_name")), " ")
    return part.select("p_partkey", F.round(fuzzy.dice(a, b), 6).alias("score"))


@query("course_library", "sentences", "documents", sql="""
WITH a AS (SELECT level, count(*) n FROM course_library WHERE level IS NOT NULL GROUP BY 1), b AS (SELECT level, count(*) n FROM sentences WHERE level IS NOT NULL GROUP BY 1), c AS (SELECT level, count(*) n FROM documents WHERE level IS NOT NULL GROUP BY 1),
k AS (SELECT level FROM a UNION SELECT level FROM b UNION SELECT level FROM c)
SELECT level, coalesce(a.n, 0)::BIGINT AS lessons, coalesce(b.n, 0)::BIGINT AS sentences, coalesce(c.n, 0)::BIGINT AS documents FROM k LEFT JOIN a USING (level) LEFT JOIN b USING (level) LEFT JOIN c USING (level)""")  # fmt: skip
def level_multi_source_summary(lib, sentences, documents):
    have = lambda df: df.select("level").filter("level is not null")
    return catalog.level_summary(lessons=have(lib), sentences=have(sentences), documents=have(documents))


# Layout ---------------------------------------------------------------------------------------------------------------


@query("page_records", sql="""
SELECT lesson_id, value, weight FROM (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY weight DESC, f) AS n FROM
  (SELECT lesson_id, round(body_size, 1) AS value, sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}]')))::BIGINT AS weight, min(page_id) AS f FROM page_records WHERE text IS NOT NULL AND body_size IS NOT NULL AND lesson_id IS NOT NULL GROUP BY 1, 2)) WHERE n = 1""")  # fmt: skip
def dominant_mode(records):
    r = records.filter("text is not null and body_size is not null and lesson_id is not null")
    return layout.weighted_mode(r, ["lesson_id"], F.round("body_size", 1), layout.letters(F.col("text")), F.col("page_id"))


@query("page_records", sql="""
WITH p AS (SELECT *, physical_page * 2 + CASE WHEN side = 'right' THEN 1 ELSE 0 END AS place FROM page_records WHERE lesson_id IS NOT NULL),
s AS (SELECT lesson_id, min(place) AS stop FROM p WHERE status = 'stop' GROUP BY 1)
SELECT page_id, CASE WHEN place > stop THEN 'after_back_matter' WHEN place = stop THEN 'stop' WHEN status = 'skip' THEN 'skip' ELSE 'body' END AS status FROM p LEFT JOIN s USING (lesson_id)""")  # fmt: skip
def sticky_stop(records):
    p = records.filter("lesson_id is not null").withColumn("place", F.col("physical_page") * 2 + F.when(F.col("side") == "right", 1).otherwise(0)).withColumnRenamed("status", "marker")
    return layout.before_stop(p, ["lesson_id"], ["place"]).select("page_id", "status")


@query("page_records", sql=f"""
SELECT page_id::VARCHAR AS doc, i::INTEGER AS line, {_line('l')} AS text FROM (SELECT page_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls, unnest(generate_series(1, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))) - 1 AS i, ls[i + 1] AS l FROM page_records WHERE text IS NOT NULL)""")
def line_clustering(records):
    """Words of each page at made-up places, a little uneven, put back into its lines."""
    ls = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    lines = records.filter("text is not null").select(F.col("page_id").cast("string").alias("doc"), F.posexplode(ls).alias("l", "line"))
    words = lines.select("doc", "l", F.posexplode(F.filter(F.split("line", r"(?U)\s+"), lambda x: x != "")).alias("i", "text"))
    top = F.col("l") * 14.0 + F.pmod(F.col("i") * 7, F.lit(5)) * 0.3
    placed = words.select("doc", F.lit(1).alias("page"), "text", (F.col("i") * 40.0).alias("x0"), (F.col("i") * 40.0 + 35).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), F.lit(10.0).alias("size"))
    return layout.grouped_lines(placed).select("doc", "line", "text")


@query("page_records")
def subset_sum_repair(records):
    """Which alternate blocks would fill the words that a lesson lacks, if it should have a fifth more than it has."""
    r = records.filter("lesson_id is not null").withColumn("n", F.coalesce(X.count_words(F.col("text")), F.lit(0)))
    block = F.when(F.col("alternate_chars") >= 60, F.struct(F.col("page_id").alias("id"), layout.block_estimate(F.col("alternate_chars")).alias("words"), layout.block_penalty(F.col("n") * 5, F.col("body_size")).alias("penalty")))
    g = r.groupBy(F.col("lesson_id").alias("doc")).agg(F.sum("n").cast("int").alias("actual"), F.array_sort(F.collect_list(block)).alias("b"))
    docs = g.select("doc", "actual", F.ceil(F.col("actual") * 1.2).cast("int").alias("expected"), F.transform("b", lambda x: x.dropFields("id")).alias("blocks"))
    return layout.repaired(docs).select("doc", F.array_join(F.col("added").cast("array<string>"), ",").alias("added"))


@query("page_records", sql="""
SELECT split_part(lesson_id, '-', 2) AS level, coalesce(side, '?') || '|' || coalesce(status, '?') || '|' || coalesce(floor(body_size)::BIGINT::VARCHAR, '?') AS layout, count(*)::BIGINT AS pages, count(text)::BIGINT AS with_text, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM page_records GROUP BY 1, 2""")
def layout_histogram(records):
    p = records.withColumn("level", X.id_part(F.col("lesson_id"), 2))
    return layout.inventory(p, "level", F.col("side"), F.col("status"), F.floor("body_size"))


# Alignment and quality ------------------------------------------------------------------------------------------------


#: Seconds that each sentence of a lesson gets on the lesson's one clock.
_SPAN = 1000.0


def _timed(lib):
    """The sentences of each lesson, and all words heard in the lesson on one clock."""
    s, w = (nested.child_table(nested.lesson_nodes(lib, c), c) for c in ("sentence", "word"))
    expected = s.filter("english is not null").select(F.col("row_id").cast("string").alias("key"), F.col("ordinal").alias("pos"), X.transcript_words(F.col("english")).alias("words"))
    heard = w.withColumn("part", X.normalize_word(F.col("text"))).filter("part != ''").withColumn("at", F.col("parent_item").cast("int"))
    row = F.array_sort(F.collect_list(F.struct("at", "ordinal", "part", (F.coalesce("start", F.lit(0.0)) + F.col("at") * _SPAN).alias("start"), (F.coalesce("end", F.lit(0.0)) + F.col("at") * _SPAN).alias("end"), F.coalesce("probability", F.lit(1.0)).alias("p"))))
    g = heard.groupBy(F.col("row_id").cast("string").alias("key")).agg(row.alias("r"))  # the words of one document
    pick = lambda f: F.transform("r", lambda x: x[f])
    return expected, g.select("key", pick("part").alias("words"), pick("start").alias("starts"), pick("end").alias("ends"), pick("p").alias("probabilities"))


@query("course_library")
def semi_global_align(lib):
    """Where the words of each sentence were heard in the recording of its whole lesson."""
    a = align.diagnosed(align.anchors(*_timed(lib)))
    return a.select("key", "pos", "matched", "expected", "first", "last", "match_ratio", "confidence")


@query("course_library")
def anchor_report(lib):
    """Sentences with and without an anchor per lesson."""
    return align.unanchored(align.anchors(*_timed(lib))).select("key", "sentences", F.size("missing").alias("missing"), "recovered")


_CLOCK = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6"


def _intervals(events):
    t = (F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6
    e = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), "event_type", t.alias("t"), "value")
    found = e.filter("event_type = 'click'").select("key", "pos", F.col("t").alias("first"), (F.col("t") + F.col("value")).alias("last"))
    quiet = e.filter("event_type = 'view'").select("key", F.col("t").alias("s_start"), (F.col("t") + F.col("value") / 10).alias("s_end"))
    return found, quiet


_SNAP = f"""
f AS (SELECT user_id AS key, event_id AS pos, {_CLOCK} AS first, {_CLOCK} + value AS last FROM events WHERE event_type = 'click'),
s AS (SELECT user_id AS key, {_CLOCK} AS a, {_CLOCK} + value / 10 AS b FROM events WHERE event_type = 'view' AND value / 10 >= 0.2),
j AS (SELECT f.key, pos, first, last, max(CASE WHEN b <= first + 0.08 AND first - (a + b) / 2 <= 0.45 THEN (a + b) / 2 END) AS x, min(CASE WHEN a >= last - 0.08 AND (a + b) / 2 - last <= 0.45 THEN (a + b) / 2 END) AS y FROM f LEFT JOIN s USING (key) GROUP BY ALL),
r AS (SELECT key, pos, first, last, greatest(0.0, coalesce(x, first - 0.18)) AS st, coalesce(y, last + 0.25) AS en FROM j)"""


@query("events", sql=f"WITH {_SNAP} SELECT key, pos, round(st, 2) AS start, round(en, 2) AS \"end\" FROM r")
def interval_snap(events):
    return align.snapped(*_intervals(events)).select("key", "pos", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


@query("events", sql=f"""
WITH {_SNAP}, o AS (SELECT *, coalesce(en > lead(st) OVER w, false) AS c, (last + lead(first) OVER w) / 2 AS meet FROM r WINDOW w AS (PARTITION BY key ORDER BY pos)),
q AS (SELECT key, pos, CASE WHEN coalesce(lag(c) OVER w, false) THEN lag(meet) OVER w ELSE st END AS st, CASE WHEN c THEN meet ELSE en END AS en FROM o WINDOW w AS (PARTITION BY key ORDER BY pos))
SELECT key, pos, round(st::DECIMAL(20, 7), 3)::DOUBLE AS start, round(en::DECIMAL(20, 7), 3)::DOUBLE AS "end" FROM q""")  # fmt: skip
def overlap_resolve(events):
    return align.without_overlaps(align.snapped(*_intervals(events))).select("key", "pos", "start", "end")


_SENT = f"SELECT row_id, coalesce(lesson_id, '') AS lesson_id, coalesce(seq, -1) AS seq, len(regexp_extract_all(coalesce(english, ''), '{_WORD_SQL}'))::BIGINT AS n FROM sentences"


def _counted(sentences):
    return sentences.select("row_id", F.coalesce("lesson_id", F.lit("")).alias("lesson_id"), F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce(X.count_words(F.col("english")), F.lit(0)).cast("bigint").alias("n"))


@query("sentences", sql=f"""
SELECT row_id, (sum(n) OVER (PARTITION BY lesson_id ORDER BY seq, row_id ROWS UNBOUNDED PRECEDING))::BIGINT AS finish, (sum(n) OVER (PARTITION BY lesson_id ORDER BY seq, row_id ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS begin FROM ({_SENT})""")
def word_offsets(sentences):
    s = ranking.running_sum(_counted(sentences), ["lesson_id"], ["seq", "row_id"], "n", "finish")
    return s.select("row_id", "finish", (F.col("finish") - F.col("n")).alias("begin"))


@query("sentences", sql=f"""
SELECT row_id, coalesce(previous_n, -1) AS previous_n, coalesce(next_n, -1) AS next_n, greatest(coalesce(previous_n, 0), coalesce(next_n, 0)) > n + 8 AS contaminated FROM (SELECT row_id, n, lag(n) OVER w AS previous_n, lead(n) OVER w AS next_n FROM ({_SENT}) WINDOW w AS (PARTITION BY lesson_id ORDER BY seq, row_id))""")
def neighbor_contamination(sentences):
    s = ranking.neighbours(_counted(sentences), ["lesson_id"], ["seq", "row_id"], ["n"])
    big = F.greatest(F.coalesce("previous_n", F.lit(0)), F.coalesce("next_n", F.lit(0))) > F.col("n") + 8
    return s.select("row_id", F.coalesce("previous_n", F.lit(-1)).alias("previous_n"), F.coalesce("next_n", F.lit(-1)).alias("next_n"), big.alias("contaminated"))


@query("events", sql="""
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events),
k AS (SELECT DISTINCT user_id, c, round_even(k * (c - 1) / 4.0, 0)::BIGINT + 1 AS i FROM (SELECT DISTINCT user_id, c FROM n) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k))
SELECT n.user_id, event_id FROM n LEFT JOIN k USING (user_id, i) WHERE n.c <= 5 OR k.i IS NOT NULL""")  # fmt: skip
def evenly_spaced_sample(events):
    return ranking.evenly_spaced(events.select("user_id", "event_id"), ["user_id"], ["event_id"], 5)


@query("events", sql="""SELECT user_id, chunk, count(*)::BIGINT AS n, min(event_id) AS first FROM (SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20)::BIGINT AS chunk FROM events) GROUP BY 1, 2""")
def chunk_batches(events):
    c = ranking.chunked(events.select("user_id", "event_id"), ["user_id"], ["event_id"], 20)
    return c.groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("lineitem", sql="""
SELECT *, coverage >= 0.90 AND weak_ratio <= 0.15 AND implausible = 0 AS passed FROM (SELECT l_orderkey AS key, count(*)::BIGINT AS clips, round(sum(l_quantity - l_linenumber % 3) / greatest(1, sum(l_quantity)), 6) AS coverage,
  count(*) FILTER (WHERE l_discount < 0.01)::BIGINT AS weak, count(*) FILTER (WHERE l_quantity < 0.45 OR l_quantity > 90)::BIGINT AS implausible, round(count(*) FILTER (WHERE l_discount < 0.01) / greatest(1, count(*)), 6) AS weak_ratio FROM lineitem GROUP BY 1)""")  # fmt: skip
def quality_gate(lineitem):
    clips = lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("expected"), (F.col("l_quantity") - F.col("l_linenumber") % 3).alias("matched"), F.col("l_discount").alias("confidence"), F.col("l_quantity").alias("duration"))
    g = quality.quality_gate(clips, confidence=0.01)
    return g.withColumns({"coverage": F.round("coverage", 6), "weak_ratio": F.round("weak_ratio", 6)})


_RESULTS = """SELECT o_orderkey, 'R-' || CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'B' END || '-' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'complete' ELSE 'skipped-existing' END AS status,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'No timestamp anchor for sentence' WHEN '2' THEN 'post-cut validation failed: 2' WHEN '3' THEN 'quality gate failed' WHEN '4' THEN 'No matching source' ELSE 'timeout' END AS error FROM orders"""


def _results(orders):
    level = F.when(F.col("o_custkey") % 3 == 0, "A").otherwise("B")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "complete").otherwise("skipped-existing")
    p = F.left("o_orderpriority", F.lit(1))
    error = F.when(p == "1", "No timestamp anchor for sentence").when(p == "2", "post-cut validation failed: 2").when(p == "3", "quality gate failed").when(p == "4", "No matching source").otherwise("timeout")
    return orders.select(F.concat_ws("-", F.lit("R"), level, "o_orderkey").alias("id"), status.alias("status"), error.alias("error"))


@query("orders", sql=f"""
SELECT split_part(id, '-', 2) AS level, CASE WHEN contains(error, 'No timestamp anchor') THEN 'missing-timestamp-anchor' WHEN contains(error, 'post-cut validation failed') THEN 'post-cut-validation' WHEN contains(error, 'quality gate failed') THEN 'quality-gate'
  WHEN contains(error, 'No matching source') THEN 'missing-source-audio' ELSE 'other' END AS reason, count(*)::BIGINT AS n FROM ({_RESULTS}) WHERE status = 'failed' GROUP BY 1, 2""")  # fmt: skip
def failure_report(orders):
    return quality.failures(_results(orders)).groupBy("level", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("orders", sql=f"""SELECT split_part(id, '-', 2) AS level, CASE WHEN status IN ('complete', 'skipped-existing') THEN 'usable' ELSE status END AS status, count(*)::BIGINT AS n FROM ({_RESULTS}) GROUP BY 1, 2""")
def status_by_level(orders):
    return quality.status_by_level(_results(orders))


# Shards and upserts ---------------------------------------------------------------------------------------------------


@query("events", sql="""
WITH s AS (SELECT user_id AS lesson_id, event_id % 4 AS shard, max(event_id) AS e FROM events GROUP BY 1, 2), st AS (SELECT s.*, event_type FROM s JOIN events ON event_id = e)
SELECT lesson_id, arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END, shard) AS status, arg_max(e, shard) AS event_id FROM st GROUP BY 1""")
def shard_merge_results(events):
    official, results = _shards(events)
    return shards.merged_results(official, results)


def _shards(events):
    """Official results, the earliest state of each lesson, and those of the shards. Every event is in a shard, so every lesson is."""
    state = lambda t: F.when(F.col(t) == "error", "failed").otherwise("complete").alias("status")
    first = events.groupBy(F.col("user_id").alias("lesson_id")).agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("t"))
    last = events.groupBy(F.col("user_id").alias("lesson_id"), (F.col("event_id") % 4).cast("int").alias("shard")).agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("t"))
    return first.select("lesson_id", state("t"), "event_id"), last.select("lesson_id", state("t"), "event_id", "shard")


@query("events", sql="""
WITH s AS (SELECT user_id, event_id % 4 AS shard, arg_max(event_type, event_id) AS t FROM events GROUP BY 1, 2), failed AS (SELECT DISTINCT user_id FROM s WHERE t = 'error'),
official AS (SELECT event_id AS sentence_id, 'official' AS url, -1 AS shard FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM failed)),
idx AS (SELECT event_id AS sentence_id, 'shard-' || (event_id % 4) AS url, event_id % 4 AS shard FROM events WHERE event_id % 3 = 0)
SELECT sentence_id, arg_max(url, shard) AS url FROM (SELECT * FROM official UNION ALL SELECT * FROM idx) GROUP BY 1""")  # fmt: skip
def shard_merge_index(events):
    _, results = _shards(events)
    keys = events.select(F.col("user_id").alias("lesson_id"), F.col("event_id").alias("sentence_id"))
    official = keys.filter("sentence_id % 2 = 0").select("sentence_id", F.lit("official").alias("url"))
    index = keys.filter("sentence_id % 3 = 0").select("sentence_id", F.concat(F.lit("shard-"), (F.col("sentence_id") % 4).cast("string")).alias("url"), (F.col("sentence_id") % 4).cast("int").alias("shard"))
    return shards.merged_index(official, index, results, keys)


@query("student_learning_state", sql="SELECT user_id, row_id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, row_id DESC) AS n FROM student_learning_state) WHERE n = 1")
def latest_states(states):
    return ranking.latest(states.select("user_id", "row_id", "updated_at"), ["user_id"], ["updated_at", "row_id"])


@query("student_learning_state", "students", sql="""
SELECT id, coalesce(r, 0)::BIGINT AS row_id FROM (SELECT DISTINCT id FROM students) LEFT JOIN (SELECT user_id, max(row_id) AS r FROM student_learning_state GROUP BY 1) ON id = user_id UNION ALL
SELECT user_id, max(row_id)::BIGINT FROM student_learning_state WHERE user_id NOT IN (SELECT id FROM students WHERE id IS NOT NULL) GROUP BY 1""")
def upsert(states, students):
    old = students.select("id", F.lit(0).cast("bigint").alias("row_id")).distinct()
    return shards.upserted(old, states.filter("user_id is not null").select(F.col("user_id").alias("id"), "row_id"), ["id"], ["row_id"])


# Learners -------------------------------------------------------------------------------------------------------------


@query("student_learning_state", sql=f"""
SELECT row_id, coalesce(json_array_length(state_json, '$.vocabulary'), 0)::INTEGER AS words, coalesce(len(json_keys(state_json, '$.progress')), 0)::INTEGER AS lessons, coalesce(json_array_length(state_json, '$.studyDays'), 0)::INTEGER AS days,
  coalesce(try_cast(json_extract_string(state_json, '$.totalSentences') AS INTEGER), 0) AS total, CASE WHEN list_contains([{_QUOTED(X.LEVELS)}], json_extract_string(state_json, '$.selectedLevel')) THEN json_extract_string(state_json, '$.selectedLevel') ELSE 'A' END AS level
FROM student_learning_state WHERE json_valid(state_json)""")  # fmt: skip
def state_defaults(states):
    return learner.states(states).select("row_id", F.size("vocabulary").alias("words"), F.size("progress").alias("lessons"), F.size("study_days").alias("days"), F.col("total_sentences").alias("total"), "level")


@query("events", sql=f"""
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), r AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS g FROM d), g AS (SELECT user_id, min(day) AS a, max(day) AS b FROM r GROUP BY user_id, g)
SELECT user_id, coalesce(max(CASE WHEN a <= DATE '{TODAY}' AND b >= DATE '{TODAY}' THEN DATE '{TODAY}' - a + 1 END), 0)::INTEGER AS streak FROM g GROUP BY 1""")  # fmt: skip
def study_streak(events):
    return learner.streak(events.select("user_id", F.to_date("ts").alias("day")), F.lit(TODAY).cast("date"))


_ATTEMPTS = "SELECT user_id, event_type AS word, event_id, value > 20 AS ok FROM events"


@query("events", sql=f"""
WITH a AS ({_ATTEMPTS}), h AS (SELECT user_id, word, min(CASE WHEN ok THEN event_id END) AS hit FROM a GROUP BY 1, 2), w AS (SELECT user_id, word, hit, count(*) FILTER (WHERE NOT ok AND (hit IS NULL OR event_id < hit)) AS m FROM a JOIN h USING (user_id, word) GROUP BY 1, 2, 3)
SELECT user_id, word, least(m, 3)::INTEGER AS wrong, CASE WHEN m >= 3 THEN 'revealed' WHEN hit IS NOT NULL THEN 'correct' ELSE 'wrong' END AS status FROM w""")  # fmt: skip
def wrong_streak_reveal(events):
    a = events.select("user_id", F.col("event_type").alias("word"), "event_id", (F.col("value") > 20).alias("right"))
    return learner.outcomes(a, ["user_id", "word"], ["event_id"])


@query("events", sql=f"""
SELECT user_id, word, 'E' || min(event_id) AS source, count(*) FILTER (WHERE ok)::BIGINT AS correct, count(*)::BIGINT AS attempts, least(5, count(*) FILTER (WHERE ok))::BIGINT AS mastery, min(event_id) AS added FROM ({_ATTEMPTS}) GROUP BY 1, 2""")
def vocab_accumulate(events):
    a = events.select("user_id", F.col("event_type").alias("word"), "event_id", (F.col("value") > 20).alias("right"), F.concat(F.lit("E"), F.col("event_id")).alias("source"))
    return learner.vocabulary(a, ["user_id", "word"], ["event_id"])


@query("sentences", sql="""
WITH l AS (SELECT lesson_id, count(*) AS total FROM sentences WHERE lesson_id IS NOT NULL GROUP BY 1), d AS (SELECT lesson_id, max(seq) AS far FROM sentences WHERE lesson_id IS NOT NULL AND length(english) > 40 GROUP BY 1)
SELECT lesson_id, total::BIGINT AS total, coalesce(far, 0)::INTEGER AS completed, floor(coalesce(far, 0) / total * 100 + 0.5)::INTEGER AS percent FROM l LEFT JOIN d USING (lesson_id)""")  # fmt: skip
def progress_percent(sentences):
    s = sentences.filter("lesson_id is not null")
    total = s.groupBy("lesson_id").agg(F.count(F.lit(1)).alias("total"))
    return learner.progress(total, s.filter("length(english) > 40").select("lesson_id", F.col("seq").alias("position")))


@query("events", sql="""SELECT user_id, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) FILTER (WHERE json_valid(props))::BIGINT AS readable FROM events GROUP BY 1""")
def json_props(events):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return events.groupBy("user_id").agg(F.sum(k).alias("total"), F.count_if(F.try_parse_json("props").isNotNull()).alias("readable"))


@query("events", sql="""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def events_daily(events):
    """The counts of a stream with a watermark, over the whole table at once."""
    from lexiloom.streaming.state import daily

    return daily(events).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("orders", sql="""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def top_three(orders):
    return catalog.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


def stream_latest(spark, d):
    """The same as ``latest_states``, folded from a stream of files into a table."""
    from lexiloom.streaming.state import follow

    at = scratch(spark, "stream")
    rows = streamed(spark, d, "student_learning_state").select("user_id", "row_id", "updated_at")
    follow(rows, f"{at}/table", f"{at}/log", ["user_id"], ["updated_at", "row_id"]).awaitTermination()
    return spark.read.parquet(f"{at}/table").drop("bucket")


QUERIES["stream_latest"] = stream_latest
SQL["stream_latest"] = SQL["latest_states"]
