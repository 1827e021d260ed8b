"""Queries of choosing and checking work: lookups, caches, samples, gates, promotion, libraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import align, learner, library, quality, ranking, selection, shards
from lexiloom.plans.reference import _JSON_LIST
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


# Lookups and caches ---------------------------------------------------------------------------------------------------


@query("sentences", "ocr_pages", sql="SELECT DISTINCT lesson_id AS id FROM sentences WHERE lesson_id NOT IN (SELECT lesson_id FROM ocr_pages WHERE lesson_id IS NOT NULL)")
def missing_lookups(sentences, pages):
    """Lessons that sentences name and no page is from."""
    return shards.missing_keys(sentences.filter("lesson_id is not null").select(F.col("lesson_id").alias("id")), pages.select(F.col("lesson_id").alias("id")).distinct(), "id")


@query("orders", "lineitem", sql="""
WITH d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F')
SELECT o_orderkey AS k, NULL::BIGINT AS size, 'pending' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT k FROM d)
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN o_custkey * 2 END, 'cached' FROM orders""")  # fmt: skip
def resumed(orders, lineitem):
    """Work that isn't done yet; and all work with its cached value where path, size and version still agree."""
    work = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("size"), F.lit(18).alias("version"))
    done = lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k")).distinct()
    cache = work.filter("k % 3 = 0").select("k", F.when(F.col("size") % 2 == 0, F.col("size")).otherwise(-1).alias("size"), "version", (F.col("size") * 2).alias("value"))
    none = F.lit(None).cast("bigint")
    waiting = shards.pending(work, done, ["k"]).select("k", none.alias("size"), F.lit("pending").alias("kind"))
    cached = shards.valid_cache(work, cache, ["k", "size", "version"]).select("k", F.col("value").alias("size"), F.lit("cached").alias("kind"))
    return waiting.unionByName(cached)


@query("sentences", "events", sql="""
SELECT row_id, CASE WHEN url IS NULL THEN 'server' ELSE 'clip' END AS mode, url FROM (SELECT row_id FROM sentences) LEFT JOIN (SELECT event_id + 10000000 AS row_id, 'clip-' || event_type AS url FROM events WHERE event_type <> 'error') USING (row_id)""")
def audio_fallback(sentences, events):
    """The clip of a sentence, else the server."""
    clips = events.filter("event_type != 'error'").select((F.col("event_id") + 10000000).alias("sentence_id"), F.concat(F.lit("clip-"), "event_type").alias("url"))
    return learner.with_fallback(sentences.select(F.col("row_id").alias("sentence_id")), clips).select(F.col("sentence_id").alias("row_id"), "mode", "url")


@query("lineitem", sql="""
WITH a AS (SELECT l_orderkey AS k, l_linenumber AS pos, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n, l_quantity AS v FROM lineitem),
l AS (SELECT k, pos, n, v FROM a WHERE k % 7 <> 0), r AS (SELECT k, pos, n, CASE WHEN v > 45 THEN -v ELSE v END AS v FROM a WHERE k % 11 <> 0)
SELECT k, pos, n, l.v AS left_value, r.v AS right_value FROM l FULL JOIN r USING (k, pos, n) WHERE l.v IS DISTINCT FROM r.v""")  # fmt: skip
def zip_checks(lineitem):
    """Places at which two lists by position differ, or one of them is longer."""
    a = ranking.numbered(lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("v")), ["k", "pos"], ["l_partkey", "l_suppkey", "l_extendedprice"], "n").select("k", "pos", "n", "v")
    right = a.filter("k % 11 != 0").withColumn("v", F.when(F.col("v") > 45, -F.col("v")).otherwise(F.col("v")))
    return shards.zip_mismatches(a.filter("k % 7 != 0"), right, ["k", "pos", "n"], "v")


@query("orders", "lineitem", sql="""
SELECT k AS lesson_id, have = want AND NOT extra AS complete FROM (SELECT k, count(*) AS want, count(g) AS have FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem) LEFT JOIN (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, 1 AS g FROM lineitem WHERE l_quantity > 3) USING (k, n) GROUP BY k)
  LEFT JOIN (SELECT o_orderkey AS k, o_orderkey % 10 = 0 AS extra FROM orders) USING (k) WHERE k IN (SELECT o_orderkey FROM orders)""")  # fmt: skip
def outputs_complete(orders, lineitem):
    """Whether exactly the expected outputs of a lesson are there."""
    name = F.col("l_linenumber").cast("string").alias("name")
    own = lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    there = own.filter("l_quantity > 3").select(F.col("l_orderkey").alias("lesson_id"), name).unionByName(orders.filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("lesson_id"), F.lit("extra").alias("name")))
    return selection.complete(own.select(F.col("l_orderkey").alias("lesson_id"), name), there)


@query("orders", sql="""SELECT CASE WHEN bad THEN 'error' ELSE 'result' END AS kind, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, o_totalprice > 400000 AS bad FROM orders) GROUP BY 1""")
def attempts_split(orders):
    """Items that came out and items that failed, each with its own columns."""
    tried = orders.select("o_orderkey", F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice")).alias("result"), F.when(F.col("o_totalprice") > 400000, F.lit("too dear")).alias("error"))
    good, bad = selection.attempted(tried, "result", "error")
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(kind).alias("kind"), "n", "keys").filter("n > 0")
    return count(good, "result").unionByName(count(bad, "error"))


@query("orders", "part", "nation", sql="""
SELECT 'chosen' AS kind, o_orderkey AS k, 0::BIGINT AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000 UNION ALL SELECT 'any', o_orderkey, 0 FROM orders WHERE o_totalprice >= 250000
UNION ALL SELECT 'the one', n_nationkey, 0 FROM nation WHERE n_name = 'NATION_3' UNION ALL SELECT 'next', p_partkey, (p_partkey + 1) % 50 FROM part
UNION ALL (SELECT 'best', p_partkey, 0 FROM part ORDER BY CASE WHEN p_name LIKE 'old%' THEN 2 ELSE 0 END + CASE WHEN p_size > 25 THEN 1.5 ELSE 0 END DESC, p_partkey LIMIT 1) UNION ALL SELECT 'first', min(p_partkey), 0 FROM part""")  # fmt: skip
def choices(orders, part, nation):
    """Optional filters, the one row, the next in a circle, the best by a score, the first."""
    o = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"))
    zero = F.lit(0).cast("bigint").alias("n")
    named = lambda df, kind, k="k", n=zero: df.select(F.lit(kind).alias("kind"), F.col(k).alias("k"), n)
    p = part.select("p_partkey", "p_name", "p_size")
    first = selection.first_or_none(part.select("p_partkey"), "p_partkey")
    out = named(selection.chosen(o, 100000, status=["F", "O"]), "chosen").unionByName(named(selection.chosen(o, 250000, status=[]), "any"))
    out = out.unionByName(named(selection.the_one(nation, F.col("n_name") == "NATION_3"), "the one", "n_nationkey")).unionByName(named(p, "next", "p_partkey", selection.cyclic_next(F.col("p_partkey"), F.lit(50)).cast("bigint").alias("n")))
    out = out.unionByName(named(selection.best_by_score(p, (F.col("p_name").startswith("old"), 2), (F.col("p_size") > 25, 1.5)), "best", "p_partkey"))
    return out.unionByName(named(part.filter(F.col("p_partkey") == (first[0] if first else None)), "first", "p_partkey"))


@query("course_library", "documents", sql="""
SELECT 'level' AS kind, level AS value, n::BIGINT AS n, row_number() OVER (ORDER BY CASE WHEN list_position(['C', 'A', 'B'], level) > 0 THEN list_position(['C', 'A', 'B'], level) ELSE 4 END, level)::BIGINT AS place FROM (SELECT level, count(*) AS n FROM course_library WHERE level IS NOT NULL GROUP BY 1)
UNION ALL SELECT 'source', source, n, row_number() OVER (ORDER BY n DESC, f) FROM (SELECT source, count(*) AS n, min(doc_id) AS f FROM documents WHERE source IS NOT NULL GROUP BY 1)""")  # fmt: skip
def listed_orders(lib, documents):
    """Values in the order of a list, and values by frequency; of equal ones the one met first."""
    levels = selection.in_order_of(lib.filter("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n")), "level", ["C", "A", "B"])
    sources = selection.by_frequency(documents.filter("source is not null"), "source", "doc_id")

    def placed(df, kind, value):
        n = ranking.numbered(df.withColumn("_at", F.monotonically_increasing_id()), [], ["_at"], "place")
        return n.select(F.lit(kind).alias("kind"), F.col(value).alias("value"), "n", "place")

    return placed(levels, "level", "level").unionByName(placed(sources, "source", "source"))


# Samples and gates ----------------------------------------------------------------------------------------------------

_EVEN = "SELECT DISTINCT {k}, c, round_even(k * (c - 1) / {m}.0, 0)::BIGINT + 1 AS i FROM (SELECT DISTINCT {k}, c FROM n) CROSS JOIN (SELECT unnest(generate_series(0, {m})) AS k)"


@query("events", sql=f"""
WITH n AS (SELECT user_id, event_id, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY value / 100, event_id) AS low, count(*) OVER (PARTITION BY user_id) AS c FROM events),
k AS ({_EVEN.format(k='user_id', m=7)}), s AS (SELECT n.user_id, event_id, v FROM n LEFT JOIN k USING (user_id, i) WHERE n.c <= 8 OR k.i IS NOT NULL OR low <= 2)
SELECT user_id AS key, count(*)::BIGINT AS sampled, count(*) FILTER (WHERE v < 0.05)::BIGINT AS failed, round(avg(v), 6) AS mean_score, count(*) FILTER (WHERE v < 0.05) / count(*) <= 0.25 AND avg(v) >= 0.8 AS passed FROM s GROUP BY 1""")  # fmt: skip
def sampled_gate(events):
    """The gate over a sample: evenly spaced clips and the weakest of each lesson."""
    clips = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), (F.col("value") / 100).alias("confidence"))
    s = quality.sampled(clips).select("key", F.col("confidence").alias("score"))
    return quality.sample_gate(s, least=0.05, failures=0.25).select("key", "sampled", "failed", F.round("mean_score", 6).alias("mean_score"), "passed")


@query("events", sql="""
WITH n AS (SELECT user_id, event_id, value / 100 AS v, lag(value / 100) OVER w AS a, lead(value / 100) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, greatest(coalesce(a, 0), coalesce(b, 0)) > v + 0.08 AS contaminated, v >= 0.72 AND NOT greatest(coalesce(a, 0), coalesce(b, 0)) > v + 0.08 AS passed FROM n""")  # fmt: skip
def full_validation(events):
    """Clips that sound more like the sentence before or behind, and those that pass."""
    clips = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), (F.col("value") / 100).alias("score"))
    n = ranking.neighbours(clips, ["key"], ["pos"], ["score"])
    return quality.contaminated(n).select(F.col("pos").alias("event_id"), "contaminated", "passed")


@query("sentences", sql="""
WITH t AS (SELECT row_id, regexp_replace(lower(english), '[^a-z0-9]', '', 'g') AS a, CASE WHEN seq % 5 = 0 THEN 'x' ELSE '' END || regexp_replace(lower(english), '[^a-z0-9]', '', 'g') AS b, english FROM sentences WHERE english IS NOT NULL)
SELECT row_id, a = b AS exact, a = b AND a <> '' AS passed FROM t""")  # fmt: skip
def strict_validation(sentences):
    """A clip passes only if what was heard is exactly the sentence, but for case, blanks and marks."""
    s = sentences.filter("english is not null").select("row_id", F.col("english").alias("expected"), F.concat(F.when(F.coalesce(F.col("seq") % 5 == 0, F.lit(False)), "x ").otherwise(""), "english", F.lit("!")).alias("heard"))
    return quality.strict(s).select("row_id", "exact", "passed")


@query("orders", "lineitem", sql="""
WITH c AS (SELECT l_orderkey AS k, count(*) AS clips, bool_and(l_discount < 0.1) AS valid FROM lineitem WHERE l_quantity > 4 GROUP BY 1), s AS (SELECT l_orderkey AS k, count(*) AS want, count(g) AS have FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, 1 AS g FROM lineitem WHERE l_quantity > 4) USING (l_orderkey, l_linenumber) GROUP BY 1)
SELECT o_orderkey AS lesson_id, CASE WHEN o_orderstatus = 'P' THEN 'exists' WHEN clips IS NULL OR NOT valid THEN 'invalid clips' WHEN clips IS DISTINCT FROM want THEN 'count' WHEN have <> want THEN 'ids' END AS problem FROM orders LEFT JOIN c ON c.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey""")  # fmt: skip
def promotion(orders, lineitem):
    """Which candidates may be published, and what keeps the others from it."""
    ids = lambda df: df.select(F.col("l_orderkey").alias("lesson_id"), F.col("l_linenumber").alias("sentence_id"))
    clips = lineitem.filter("l_quantity > 4").select(F.col("l_orderkey").alias("lesson_id"), F.col("l_linenumber").alias("sentence_id"), (F.col("l_discount") < 0.1).alias("passed"))
    return shards.promoted(orders.select(F.col("o_orderkey").alias("lesson_id")), clips, ids(lineitem).distinct(), orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("lesson_id")))


@query("orders", sql=f"""
WITH n AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders), k AS ({_EVEN.format(k='o_orderpriority', m=9)})
SELECT n.o_orderpriority, o_orderkey FROM n LEFT JOIN k USING (o_orderpriority, i) WHERE n.c <= 10 OR k.i IS NOT NULL""")  # fmt: skip
def stratified_sample(orders):
    """Ten evenly spaced rows of each stratum."""
    return quality.stratified(orders.select("o_orderpriority", "o_orderdate", "o_orderkey"), "o_orderpriority", ["o_orderdate", "o_orderkey"]).select("o_orderpriority", "o_orderkey")


_RISKY = "SELECT l_orderkey AS id FROM lineitem WHERE l_quantity < 3 UNION SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 400000"


@query("orders", "lineitem", sql=f"""
WITH r AS ({_RISKY}), w AS (SELECT o_orderkey AS id, o_custkey AS base, o_totalprice / 1000 AS rough FROM orders), d AS (SELECT id FROM w WHERE id % 5 = 0),
a AS (SELECT id, base + 0.25::DOUBLE AS source_start, base + 1.25::DOUBLE AS source_end, round(base + 0.25 - rough, 6) AS drift_start, true AS fresh FROM w WHERE id IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM d))
SELECT * FROM a UNION ALL SELECT id, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, false FROM d""")  # fmt: skip
def refined_windows(orders, lineitem):
    """Windows of risky sentences that aren't done yet, aligned anew and put into the table of what was done."""
    risky = quality.risky(lineitem.filter("l_quantity < 3").select(F.col("l_orderkey").alias("id")), lineitem.filter("l_discount > 0.09").select(F.col("l_orderkey").alias("id")), orders.filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("id")))
    w = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("base"), F.lit(0.25).alias("start"), F.lit(1.25).alias("end"), (F.col("o_totalprice") / 1000).alias("coarse_start"), (F.col("o_totalprice") / 1000 + 1).alias("coarse_end"))
    done = w.filter("id % 5 = 0").select("id", F.lit(0.0).alias("source_start"), F.lit(1.0).alias("source_end"), F.lit(0.0).alias("drift_start"), F.lit(1.0).alias("drift_end"), F.lit(False).alias("fresh"))
    out = align.refined(w, risky, done, "base")
    return out.select("id", "source_start", "source_end", F.round("drift_start", 6).alias("drift_start"), "fresh")


@query("events", sql="""
WITH f AS (SELECT user_id AS key, event_id AS pos, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t FROM events WHERE event_type = 'click'), s AS (SELECT user_id AS key, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS a, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 + value AS b FROM events WHERE event_type = 'view')
SELECT key, pos, round(arg_min((a + b) / 2, abs((a + b) / 2 - t)), 3) AS mid FROM f JOIN s USING (key) WHERE b - a >= 5 AND abs((a + b) / 2 - t) <= 20000 GROUP BY 1, 2""")  # fmt: skip
def nearest_silences(events):
    """The middle of the silence nearest to each anchor, where one is long and near enough."""
    t = (F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6
    e = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), "event_type", t.alias("t"), "value")
    near = align.nearest(e.filter("event_type = 'click'").select("key", "pos", "t"), e.filter("event_type = 'view'").select("key", F.col("t").alias("s_start"), (F.col("t") + F.col("value")).alias("s_end")), least=5.0, window=20000.0)
    return near.select("key", "pos", F.round("mid", 3).alias("mid"))


# Libraries ------------------------------------------------------------------------------------------------------------

_ISSUES = """list_filter([CASE WHEN list_bool_or(list_transform(['[non-text]', 'ground truth', 'quick brown fox', 'the image contains', 'www.', 'http://', 'https://', chr(65533), '||'], lambda p: contains(lower(array_to_string(t, ' ')), p))) THEN 'artifact_text' END,
  CASE WHEN list_bool_or(list_transform(t, lambda x: NOT regexp_matches(x, '[.!?]["''’”)]*$'))) THEN 'missing_terminal_punctuation' END, CASE WHEN list_bool_or(list_transform(t, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+(?:[-’''][A-Za-z0-9]+)*')) > 70)) THEN 'very_long_sentence' END,
  CASE WHEN list_bool_or(list_transform(t, lambda x: contains(x, repeat('.', 24)))) THEN 'table_of_contents_text' END], lambda x: x IS NOT NULL)"""
#: ``e``: the English of the sentences of a lesson that are strings or missing, null where the document can't be read.
_ENGLISH = f"SELECT *, list_transform(from_json(CASE WHEN json_type(j) = 'ARRAY' THEN j END, '[\"json\"]'), lambda s: json_extract_string(s, '$.english')) AS e FROM (SELECT *, {_JSON_LIST} AS j FROM course_library)"
_KEPT = "list_filter(list_transform(e, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')"


SQL["library_review"] = f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY id, coalesce(source_name, '') ORDER BY row_id DESC) AS n, min(row_id) OVER (PARTITION BY id, coalesce(source_name, '')) AS f FROM ({_ENGLISH})),
g AS (SELECT *, upper(level) AS l, coalesce(try_cast(nullif(regexp_extract(id, '([0-9]+)$', 1), '') AS BIGINT), 9999) AS num, {_KEPT} AS t FROM k WHERE n = 1 AND regexp_matches(upper(level), '^[A-Z]$')),
r AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY num, coalesce(source_name, ''), coalesce(title, ''), f) AS i, coalesce(len(t), 0)::INTEGER AS sentence_count, coalesce(list_sum(list_transform(t, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+(?:[-’''][A-Za-z0-9]+)*')))), 0)::INTEGER AS word_count,
  CASE WHEN coalesce(len(t), 0) = 0 THEN ['no_sentences'] ELSE {_ISSUES} END AS why FROM g)
SELECT 'RAZ-' || l || '-' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INTEGER, '0') AS id, CASE WHEN len(why) > 0 THEN 'review' ELSE 'pass' END AS status, array_to_string(why, ',') AS reasons, sentence_count, word_count FROM r"""


@query("course_library", sql=f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY id, coalesce(source_name, '') ORDER BY row_id DESC) AS n FROM ({_ENGLISH})), g AS (SELECT {_KEPT} AS t FROM k WHERE n = 1 AND regexp_matches(upper(level), '^[A-Z]$')),
r AS (SELECT coalesce(len(t), 0) AS s, coalesce(list_sum(list_transform(t, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+(?:[-’''][A-Za-z0-9]+)*')))), 0) AS w, coalesce(len(t), 0) > 0 AND len({_ISSUES}) = 0 AS ok FROM g)
SELECT count(*)::BIGINT AS lessons, count(*) FILTER (WHERE ok)::BIGINT AS passed, count(*) FILTER (WHERE NOT ok)::BIGINT AS in_review, sum(s)::BIGINT AS sentences, sum(w)::BIGINT AS words, 0::BIGINT AS duplicate_ids FROM r""")  # fmt: skip
def library_summary(lib):
    """Counts of the built library, and of generated ids that aren't unique."""
    built = library.built(lib.withColumn("sentences", library.parsed_sentences(F.col("sentences_json"))))
    return library.summary(built).crossJoin(F.broadcast(library.duplicate_ids(built).agg(F.count(F.lit(1)).alias("duplicate_ids"))))


@query("course_library", sql="""
WITH m AS (SELECT upper(level) || ':' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS order_key, min(row_id)::INTEGER AS position FROM course_library WHERE row_id % 2 = 0 AND title IS NOT NULL AND level IS NOT NULL GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY id, coalesce(source_name, '') ORDER BY row_id DESC) AS n, min(row_id) OVER (PARTITION BY id, coalesce(source_name, '')) AS f FROM course_library),
g AS (SELECT *, upper(level) AS l, coalesce(try_cast(nullif(regexp_extract(id, '([0-9]+)$', 1), '') AS BIGINT), 9999) AS num FROM k WHERE n = 1 AND regexp_matches(upper(level), '^[A-Z]$')),
o AS (SELECT g.*, position FROM g LEFT JOIN m ON order_key = l || ':' || regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g')),
r AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY coalesce(position, 9999), num, coalesce(source_name, ''), coalesce(title, ''), f) AS i FROM o)
SELECT 'RAZ-' || l || '-' || lpad(coalesce(position, i)::VARCHAR, greatest(3, length(coalesce(position, i)::VARCHAR))::INTEGER, '0') AS id, id AS source_lesson_id, coalesce(source_name, '') AS source_name FROM r""")  # fmt: skip
def library_ordered(lib):
    """The library in a configured order, where that names a title."""
    keyed = lib.filter("row_id % 2 = 0 and title is not null and level is not null").select(F.concat_ws(":", F.upper("level"), X.title_key(F.col("title"))).alias("order_key"), "row_id")
    order = keyed.groupBy("order_key").agg(F.min("row_id").cast("int").alias("position"))
    return library.built(lib.withColumn("sentences", library.parsed_sentences(F.col("sentences_json"))), order).select("id", "source_lesson_id", "source_name")


_N = "coalesce(list_sum(list_transform({}, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+(?:[’''][A-Za-z]+)*(?:-[A-Za-z0-9]+)*')))), 0)"


@query("course_library", sql=f"""
WITH s AS (SELECT row_id, list_filter(e, lambda x: x IS NOT NULL) AS b FROM ({_ENGLISH}) WHERE e IS NOT NULL), q AS (SELECT row_id, b, {_N.format('b')}::INTEGER AS expected, b || ['Try This at home with a friend today', 'More of it'] AS t FROM s)
SELECT row_id, len(CASE WHEN expected > 0 AND len(b) >= (len(b) + 2) * 0.65 THEN b ELSE t END)::INTEGER AS n, array_to_string(list_filter([CASE WHEN expected > 0 THEN 'word_count_delta:+11' END], lambda x: x IS NOT NULL AND 11 / greatest(expected, 1) > 0.03), ',') AS reasons
FROM q WHERE len(list_filter(b, lambda x: regexp_matches(x, '^(Fire Safety Tips|Discussion Questions|Extension Activity|Think About It|Try This)'))) = 0""")  # fmt: skip
def supplements_trimmed(lib):
    """Lessons with a supplement behind them, cut off where that brings them nearer to their word count; and the delta as a reason."""
    s = lib.select("row_id", F.filter(F.transform(library.parsed_sentences(F.col("sentences_json")), lambda x: x["english"]), lambda x: x.isNotNull()).alias("b")).filter("b is not null")
    s = s.filter(~F.exists("b", lambda x: F.exists(F.array(*[F.lit(h) for h in X.SUPPLEMENTS]), lambda h: F.startswith(x, h))))
    expected = F.aggregate(F.transform("b", lambda x: X.count_words(x)), F.lit(0), lambda a, b: a + b)
    t = F.concat("b", F.array(F.lit("Try This at home with a friend today"), F.lit("More of it")))
    q = s.select("row_id", t.alias("t"), expected.alias("expected"))
    delta = F.filter(library.extraction_issues(F.col("t"), F.col("expected")), lambda r: r.startswith("word_count_delta"))
    return q.select("row_id", F.size(library.trimmed(F.col("t"), F.col("expected"))).alias("n"), F.array_join(delta, ",").alias("reasons"))


SQL["corrections_applied"] = f"""
WITH s AS (SELECT row_id, level, title, list_transform(from_json(CASE WHEN json_type(j) = 'ARRAY' THEN j END, '["json"]'), lambda x: json_extract_string(x, '$.english')) AS e FROM ({_ENGLISH.replace(_ENGLISH[_ENGLISH.index('list_transform'):_ENGLISH.index(' AS e')], 'NULL')})),
l AS (SELECT * FROM s WHERE len(e) > 0 AND level IS NOT NULL AND title IS NOT NULL), f AS (SELECT level, title, arg_min_null(e[1], row_id) AS old FROM l GROUP BY 1, 2),
h AS (SELECT row_id, e, old, len(list_filter(e, lambda x: x = old)) AS hits, list_contains(e, '(1) ' || old) AND list_contains(e, '(2) ' || old) AS there FROM l JOIN f USING (level, title))
SELECT row_id, CASE WHEN old IS NULL THEN 'none' WHEN hits = 1 THEN 'applied' WHEN hits > 1 THEN 'ambiguous' WHEN there THEN 'already' ELSE 'missing' END AS correction, (len(e) + CASE WHEN old IS NOT NULL AND hits = 1 THEN 1 ELSE 0 END)::INTEGER AS n FROM h"""
