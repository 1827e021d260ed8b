"""Queries of sources, sinks, engines and streams: tables written in each format and read again, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import catalog, layout, library, shards
from lexiloom.plans import reference, work
from lexiloom.session import scratch, table
from lexiloom.sources import engines, readers, sinks
from lexiloom.streaming import state

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT 'list' AS shape, r_name AS id, 'A' AS level, 1::INTEGER AS sentences FROM region UNION ALL SELECT 'object', r_name, 'A', 1 FROM region
UNION ALL SELECT 'document', 'regions', NULL, count(*)::INTEGER FROM region""")
def json_documents(spark, d):
    """Lessons of JSON files of both shapes, a document, and one that isn't there."""
    at = scratch(spark, "documents")
    one = F.struct(F.col("r_name").alias("id"), F.lit("A").alias("level"), F.col("r_name").alias("title"), F.array(F.struct(F.lit("1").alias("id"), F.lit("Hi.").alias("english"))).alias("sentences"))
    every = table(spark, d, "region").agg(F.sort_array(F.collect_list(one)).alias("lessons"))  # the five regions
    every.select(F.to_json("lessons").alias("value")).coalesce(1).write.text(f"{at}/list")
    every.select(F.to_json(F.struct("lessons")).alias("value")).coalesce(1).write.text(f"{at}/object")
    shape = F.regexp_extract("file", "/(list|object)/", 1)
    lessons = readers.lessons(spark, f"{at}/*/*.txt").select(shape.alias("shape"), "id", "level", F.size("sentences").alias("sentences"))
    schema = f"lessons array<{readers.LESSON}>"
    document = readers.json_or_empty(spark, f"{at}/object", schema).unionByName(readers.json_or_empty(spark, f"{at}/none", schema))
    return lessons.unionByName(document.select(F.lit("document").alias("shape"), F.lit("regions").alias("id"), F.lit(None).cast("string").alias("level"), F.size("lessons").alias("sentences")))


@query("""SELECT c_custkey % 2 AS kind, c_mktsegment AS level, 'L-' || c_custkey AS lesson_id, c_name || ', "' || c_nationkey || '"' AS title, 'Line' || chr(10) || c_name AS english FROM customer""")
def csv_files(spark, d):
    """CSV files with two different headers, quotes and line feeds."""
    at = scratch(spark, "csv")
    c = table(spark, d, "customer")
    title, english = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_nationkey"), F.lit('"')), F.concat(F.lit("Line\n"), F.col("c_name"))
    lesson = F.concat(F.lit("L-"), F.col("c_custkey"))
    options = {"header": True, "quote": '"', "escape": '"', "quoteAll": True}
    c.filter("c_custkey % 2 = 0").select(lesson.alias("Lesson_ID"), F.col("c_mktsegment").alias("LEVEL"), title.alias("title"), english.alias("text")).write.options(**options).csv(f"{at}/a")
    c.filter("c_custkey % 2 = 1").select(english.alias("原文"), title.alias("课程名"), F.lit("x").alias("other"), F.col("c_mktsegment").alias("级别"), lesson.alias("课程ID")).write.options(**options).csv(f"{at}/b")
    rows = readers.csv_rows(spark, f"{at}/*/*.csv")
    return rows.select(F.when(F.col("file").contains("/a/"), 0).otherwise(1).cast("bigint").alias("kind"), "level", "lesson_id", "title", "english")


@query("""SELECT 'p' || page_id AS path, CASE WHEN page % 2 = 0 THEN 'up' ELSE 'down' END AS orientation, CASE WHEN page % 2 = 0 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS score FROM ocr_pages WHERE vision IS NOT NULL""")
def recognised_pages(spark, d):
    """A cache of recognised pages as JSON lines: two orientations of each, errors among them."""
    at = scratch(spark, "cache")
    p = table(spark, d, "ocr_pages")
    row = lambda way, score: F.to_json(F.struct(F.concat(F.lit("p"), F.col("page_id")).alias("path"), F.lit(way).alias("orientation"), score.alias("score"), F.when(F.col("vision").isNull(), "no text").alias("error")))
    p.select(F.explode(F.array(row("up", F.lit(2.0)), row("down", F.when(F.col("page") % 2 == 0, 2.0).otherwise(3.0)), F.lit("broken {"))).alias("value")).write.text(at)
    return readers.ocr_cache(spark, at).select("path", "orientation", "score")


@query("""SELECT 'all' AS kind, id FROM (SELECT DISTINCT trim(id) AS id FROM course_library WHERE trim(id) <> '') UNION ALL SELECT 'some', id FROM (SELECT DISTINCT trim(id) AS id FROM course_library) WHERE split_part(id, '-', 2) IN ('A', 'C')""")
def id_lists(spark, d):
    """Lists of ids with comments and blank lines; all, and those of some levels."""
    at = scratch(spark, "ids")
    table(spark, d, "course_library").select(F.trim("id").alias("id")).distinct().select(F.explode(F.array(F.concat(F.lit(" "), "id", F.lit("  ")), F.lit("# a comment"), F.lit(""))).alias("value")).filter("value is not null").write.text(at)
    named = lambda kind, parts: readers.listed(spark, at, parts).select(F.lit(kind).alias("kind"), "id")
    return named("all", None).unionByName(named("some", ["A", "C"]))


@query("""SELECT c_mktsegment AS speaker, count(*)::BIGINT AS lines, true AS listed FROM customer GROUP BY 1""")
def label_files(spark, d):
    """Texts as plain files in a folder for each speaker, read and listed again."""
    at = scratch(spark, "labels")
    sinks.labels(table(spark, d, "customer").select(F.col("c_mktsegment").alias("speaker"), F.col("c_name").alias("text")), at)
    folder = F.regexp_extract("path", "speaker=([^/]*)/", 1)
    there = readers.files(spark, at, ".txt").select(F.url_decode(folder).alias("speaker")).distinct().withColumn("listed", F.lit(True))
    lines = spark.read.text(at).groupBy("speaker").agg(F.count(F.lit(1)).alias("lines"))
    return lines.join(there, "speaker", "left").select("speaker", "lines", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS a, l_quantity + l_tax * 10 - 0.3 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN round(b, 2) > a THEN 1 ELSE 0 END::INTEGER + 1 AS silences, 3600 + l_linenumber * 60 + 2.5::DOUBLE AS duration FROM l""")
def recording_logs(spark, d):
    """Silences and durations out of the logs of recordings; silences that don't run forward are left out."""
    a, b = F.col("l_quantity"), F.round(F.col("l_quantity") + F.col("l_tax") * 10 - 0.3, 2)
    log = F.concat(F.lit("  Duration: 01:"), F.format_string("%02d", F.col("l_linenumber").cast("int")), F.lit(":02.50, start: 0\n[x] silence_start: "), a, F.lit("\n[x] silence_end: "), b, F.lit(" | silence_duration: 1\n[x] silence_start: 90\n[x] silence_end: 91.25 | x"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.size(readers.silences(log)).alias("silences"), readers.log_duration(log).alias("duration"))


@query("""SELECT p_partkey, 0.5::DOUBLE AS first, 2.25::DOUBLE AS last, 2::INTEGER AS words FROM part""")
def alignment_grids(spark, d):
    """First and last bound and number of the words of alignment grids; pauses don't count."""
    word = lambda i: F.split("p_name", " ")[i]
    interval = lambda a, b, t: F.concat(F.lit(f'xmin = {a}\nxmax = {b}\ntext = "'), t, F.lit('"\n'))
    grid = F.concat(F.lit('item [1]:\nname = "phones"\n'), interval(0, 9, F.lit("x")), F.lit('item [2]:\nname = "words"\n'), interval(0, 0.5, F.lit("")), interval(0.5, 1, word(0)), interval(1, 1.5, F.lit("<eps>")), interval(1.5, 2.25, word(1)), interval(2.25, 3, F.lit("<eps>")))
    return table(spark, d, "part").select("p_partkey", readers.grid_bounds(grid).alias("g")).select("p_partkey", "g.*")


@query("""SELECT 'part' AS kind, p_partkey AS key, i::INTEGER AS part, string_split(p_name, ' ')[i + 1] AS word, round(p_size + i * 0.5, 6)::DOUBLE AS start FROM part CROSS JOIN (SELECT unnest([0, 1]) AS i) WHERE p_size % 10 <> 0
UNION ALL SELECT 'mismatch', p_partkey, 0, NULL, 2 FROM part WHERE p_size % 10 = 0""")
def timed_words(spark, d):
    """Tokens of several words with their time evenly split; tokens too short are dropped and show as a mismatch."""
    p = table(spark, d, "part")
    tokens = p.select(F.col("p_partkey").alias("key"), F.lit(0).alias("seq"), F.col("p_name").alias("text"), F.col("p_size").cast("double").alias("start"), (F.col("p_size") + F.when(F.col("p_size") % 10 == 0, 0.03).otherwise(1.0)).alias("end"), F.lit(1.0).alias("probability"))
    parts = readers.timed_parts(tokens)
    bad = readers.part_mismatches(parts, p.select(F.col("p_partkey").alias("key"), F.size(F.split("p_name", " ")).alias("words")))
    return parts.select(F.lit("part").alias("kind"), "key", F.col("part").cast("int").alias("part"), "word", F.round("start", 6).alias("start")).unionByName(
        bad.select(F.lit("mismatch").alias("kind"), "key", F.col("timed").cast("int").alias("part"), F.lit(None).cast("string").alias("word"), F.col("words").cast("double").alias("start"))
    )


_HALVES = """WITH w AS (SELECT l_orderkey AS doc, l_partkey, l_suppkey, l_linenumber + 1 AS page, l_returnflag || l_linestatus || l_linenumber AS text, l_quantity * 10 AS x0, floor(l_extendedprice)::BIGINT % 300 AS top, CASE WHEN l_orderkey % 2 = 0 THEN 612.0 ELSE 400.0 END::DOUBLE AS width FROM lineitem),
h AS (SELECT *, width > 500 AS wide, CASE WHEN width > 500 THEN x0 + x0 + 20 >= 612 ELSE top + top + 10 >= 500 END AS second FROM w WHERE page > 2)
SELECT doc, page::INTEGER AS page, CASE WHEN wide THEN CASE WHEN second THEN 'right' ELSE 'left' END ELSE CASE WHEN second THEN 'bottom' ELSE 'top' END END AS side, CASE WHEN NOT wide AND second THEN reverse(text) ELSE text END AS text,
  CASE WHEN wide THEN x0 - CASE WHEN second THEN 306 ELSE 0 END WHEN second THEN 400 - (x0 + 20) ELSE x0 END AS x0, CASE WHEN wide OR NOT second THEN top::DOUBLE ELSE 250 - (top + 10 - 250) END::DOUBLE AS top FROM h"""


@query(_HALVES)
def half_pages(spark, d):
    """Words of physical pages as words of their halves, the lower halves turned."""
    li = table(spark, d, "lineitem")
    x0, top = F.col("l_quantity") * 10, (F.floor("l_extendedprice") % 300).cast("double")
    w = li.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") + 1).cast("int").alias("page"), F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("text"), x0.alias("x0"), (x0 + 20).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), F.lit(10.0).alias("size"), F.lit("F").alias("font"), F.when(F.col("l_orderkey") % 2 == 0, 612.0).otherwise(400.0).alias("width"), F.lit(500.0).alias("height"))
    return layout.logical_pages(w).select("doc", "page", "side", "text", "x0", "top")


def _client():
    """A stand-in for an engine: fails once for some words, always for others."""
    tries: dict[str, int] = {}

    def ask(x):
        tries[x] = tries.get(x, 0) + 1
        if x.endswith("7") or x.endswith("3") and tries[x] % 2 == 1:
            raise TimeoutError("no answer")
        return x.upper()

    return ask


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 <> 7 THEN upper(p_name || p_partkey) END AS result, CASE WHEN p_partkey % 10 = 7 THEN 'TimeoutError: no answer' END AS error, CASE p_partkey % 10 WHEN 7 THEN 3 WHEN 3 THEN 2 ELSE 1 END::INTEGER AS attempts FROM part""")
def engine_calls(spark, d):
    """Answers of an engine with attempts; what fails each time comes out with its error."""
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("x"))
    return engines.called(p, "p_partkey", "x", _client, pause=0.0)


@query("""SELECT 'level' AS kind, level, count(*)::BIGINT AS n FROM (SELECT upper(level) AS level FROM (SELECT *, row_number() OVER (PARTITION BY id, coalesce(source_name, '') ORDER BY row_id DESC) AS k FROM course_library) WHERE k = 1 AND regexp_matches(upper(level), '^[A-Z]$')) GROUP BY 2
UNION ALL SELECT 'passed', 'all', passed FROM (""" + work.SQL["library_summary"] + ")")
def library_packages(spark, d):
    """A library written by level and its passed lessons, read again."""
    at = scratch(spark, "packages")
    lib = table(spark, d, "course_library")
    sinks.packages(library.built(lib.withColumn("sentences", library.parsed_sentences(F.col("sentences_json")))), at)
    kind = lambda k: F.lit(k).alias("kind")
    n = F.count(F.lit(1)).alias("n")
    return spark.read.json(f"{at}/levels").groupBy(kind("level"), "level").agg(n).unionByName(spark.read.json(f"{at}/passed").agg(n).select(kind("passed"), F.lit("all").alias("level"), "n"))


@query("""SELECT 'published' AS kind, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'accepted', count(*), sum(o_orderkey) FROM orders WHERE o_totalprice > 100000
UNION ALL SELECT 'rejected', count(*), sum(o_orderkey) FROM orders WHERE NOT o_totalprice > 100000 UNION ALL SELECT 'appended', 2 * count(*), 2 * sum(o_orderkey) FROM orders UNION ALL SELECT 'lines', count(*), sum(o_orderkey) FROM orders
UNION ALL SELECT 'table', count(*), sum(o_orderkey) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'deleted', count(*), sum(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def written_tables(spark, d):
    """Tables published in place of older ones, parted by a gate, appended to, appended without what is there, made once, deleted from."""
    at = scratch(spark, "tables")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    for status in ("F", "O"):  # the second takes the place of the first
        sinks.published(o.filter(F.col("o_orderstatus") == status), f"{at}/published")
    sinks.quarantined(o.withColumn("passed", F.col("o_totalprice") > 100000), f"{at}/gate")
    for _ in range(2):
        sinks.appended(o, f"{at}/appended")
        sinks.appended_lines(o.filter("o_orderkey % 2 = 0") if _ == 0 else o, f"{at}/lines", ["o_orderkey"])
        sinks.ensured(spark, "made_once", "o_orderkey bigint", f"{at}/made")
        if _ == 0:
            o.filter("o_orderstatus = 'F'").select("o_orderkey").write.insertInto("made_once")
    spark.sql("DROP TABLE IF EXISTS made_once")  # the files stay
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    read = lambda p: spark.read.parquet(f"{at}/{p}")
    parts = {"published": read("published"), "accepted": read("gate/accepted"), "rejected": read("gate/rejected"), "appended": read("appended"), "lines": spark.read.schema("o_orderkey bigint").json(f"{at}/lines"), "table": read("made"), "deleted": shards.deleted(o, gone, ["o_custkey"])}
    out = None
    for kind, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(kind).alias("kind"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT c_custkey, c_name, 0::BIGINT AS out_of_order FROM customer""")
def sorted_files(spark, d):
    """A map written in order of its key; no key of a file is smaller than the one before it, or than all of the files before."""
    at = scratch(spark, "sorted")
    sinks.sorted_map(table(spark, d, "customer").select("c_custkey", "c_name"), at, "c_custkey")
    rows = spark.read.schema("c_custkey bigint, c_name string").json(at).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1))
    ends = rows.groupBy("file").agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))
    other = ends.select(F.col("file").alias("f"), F.col("lo").alias("l"))
    bad = ends.join(F.broadcast(other), (F.col("file") < F.col("f")) & (F.col("hi") > F.col("l"))).agg(F.count(F.lit(1)).alias("out_of_order"))
    return rows.select("c_custkey", "c_name").crossJoin(F.broadcast(bad))


# Catalog with overrides -----------------------------------------------------------------------------------------------


@query(f"""
WITH {reference._SIDES}, {reference._MARGIN}, v AS (SELECT left_id, CASE WHEN k % 2 = 0 THEN right_id END AS forced FROM (SELECT left_id, right_id, length(left_id) AS k FROM m WHERE length(left_id) % 3 = 0)), u AS (SELECT DISTINCT forced FROM v WHERE forced IS NOT NULL),
o AS (SELECT m.*, v.left_id IS NOT NULL AS given, forced, m.right_id IN (SELECT forced FROM u) AS used, score >= 0.9999 OR (score >= 0.84 AND margin >= 0.035) AS ok FROM m LEFT JOIN v ON v.left_id = m.left_id),
t AS (SELECT *, coalesce(max((ok AND NOT given)::INT) OVER (PARTITION BY right_id ORDER BY score DESC, margin DESC, left_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS taken FROM o)
SELECT block, left_id, CASE WHEN given THEN forced ELSE right_id END AS right_id, CASE WHEN given AND forced IS NULL THEN 'disabled' WHEN given THEN 'override' WHEN used OR taken THEN 'audio-already-used' WHEN NOT ok THEN 'ambiguous-or-low-score' ELSE 'mapped' END AS outcome FROM t""")
def catalog_overrides(spark, d):
    """The assignment with lessons switched off or given a recording by hand."""
    lib, pages = table(spark, d, "course_library"), table(spark, d, "ocr_pages")
    m = reference._margins(catalog.title_pairs(*reference._titles(lib, pages)), lib, pages)
    n = F.length("left_id")
    overrides = m.filter(n % 3 == 0).select("left_id", F.when(n % 2 == 0, F.col("right_id")).alias("right_id")).distinct()
    return catalog.assigned(m, overrides).select("block", "left_id", "right_id", "outcome")


# Streams --------------------------------------------------------------------------------------------------------------


@query(f"SELECT * REPLACE (user_id::VARCHAR AS user_id) FROM ({reference.SQL['wrong_streak_reveal']})")
def stream_attempts(spark, d):
    """The same as ``wrong_streak_reveal``, folded from a stream with a state for each word."""
    at = scratch(spark, "attempts")
    e = reference.streamed(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("word"), F.col("event_id").alias("attempt"), (F.col("value") > 20).alias("right"))
    state.collected(state.fold_attempts(e), f"{at}/table", f"{at}/log", "update").awaitTermination()
    rows = spark.read.parquet(f"{at}/table")
    last = rows.groupBy("user_id", "word").agg(F.max_by(F.struct("wrong", "status"), "batch").alias("r"))
    return last.select("user_id", "word", "r.wrong", "r.status")


@query(reference.SQL["session_join_ttl"])
def stream_sessions(spark, d):
    """The same as ``session_join_ttl`` over a stream of sessions."""
    at = scratch(spark, "sessions")
    live = state.live(reference.streamed(spark, d, "sessions"), table(spark, d, "students"), F.lit(reference.NOW))
    state.collected(live, f"{at}/table", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/table").drop("batch")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once(spark, d):
    """Each key of a stream once, whoever asks again; the stream is looked at until it has read everything."""
    at = scratch(spark, "once")
    keys = state.once(reference.streamed(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])
    q = state.collected(keys, f"{at}/table", f"{at}/log")
    state.until(q, lambda x: not x.isActive, every=0.5)
    return spark.read.parquet(f"{at}/table").drop("batch")
