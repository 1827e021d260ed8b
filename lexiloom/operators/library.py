"""Building a lesson library: import checks, latest copies, order, numbers, review reasons, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.functions.numeric import reasons, spliced
from lexiloom.operators.ranking import numbered, with_first_place

SENTENCES = "array<struct<id:string,english:string,chinese:string>>"


def parsed_sentences(json: Column) -> Column:
    """A list of sentences, or the list in ``sentences`` of an object; null where the text reads as neither."""
    return F.when(F.ltrim(json).startswith("["), F.from_json(json, SENTENCES)).otherwise(F.from_json(json, f"struct<sentences:{SENTENCES}>")["sentences"])


def violations(lessons: DataFrame, least: int = 1, most: int = 3000, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, problem`` of everything an import would be refused for; a row with a null id for a wrong number of lessons.

    ``lessons``: ``id, level, title, sentences``, and the columns ``keep``, which come out too. Nothing to complain about gives
    no rows.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    problem = reasons(
        (blank(F.col("id")), "id"), (blank(F.col("level")), "level"), (blank(F.col("title")), "title"), (F.coalesce(F.size("sentences"), F.lit(0)) < 1, "sentences"),
        (F.exists(F.coalesce("sentences", F.array().cast(SENTENCES)), lambda s: blank(s["id"]) | blank(s["english"])), "english"),
    )
    rows = lessons.select("id", F.explode(problem).alias("problem"), *keep)
    size = lessons.agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") < least) | (F.col("n") > most))
    return rows.unionByName(size.select(F.lit(None).cast("string").alias("id"), F.lit("lesson count").alias("problem")), allowMissingColumns=True)


def deduplicated(lessons: DataFrame, keys: tuple[str, ...] = ("id", "source_name"), order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The last copy of each key, at the place of its first; null parts of a key count as empty."""
    filled = lessons.withColumns({k: F.coalesce(k, F.lit("")) for k in keys})
    return with_first_place(filled, list(keys), list(order))


def sentence_issues(sentences: Column) -> Column:
    """Reasons to review a lesson, from its non-blank sentences."""
    texts = F.filter(F.transform(sentences, lambda s: F.trim(s["english"])), lambda t: t != "")
    joined = F.array_join(texts, " ")
    found = reasons(
        (X.contains_any(joined, X.ARTIFACTS), "artifact_text"),
        (F.exists(texts, lambda t: ~X.has_final_mark(t)), "missing_terminal_punctuation"),
        (F.exists(texts, lambda t: X.count_words(t, X.BUILDER_WORD) > 70), "very_long_sentence"),
        (F.exists(texts, lambda t: t.contains("." * 24)), "table_of_contents_text"),
    )
    return F.when(F.coalesce(F.size(texts), F.lit(0)) < 1, F.array(F.lit("no_sentences"))).otherwise(found)


def extraction_issues(sentences: Column, expected: Column) -> Column:
    """Reasons to review extracted text (``array<string>``) whose number of words should be ``expected`` (may be null)."""
    n = F.aggregate(F.transform(sentences, lambda s: X.count_words(s)), F.lit(0), lambda a, b: a + b)
    delta = n - expected
    return reasons(
        (F.size(sentences) == 0, "no_sentences"),
        ((expected > 0) & (F.abs(delta) / F.greatest(expected, F.lit(1)) > 0.03), F.concat(F.lit("word_count_delta:"), F.when(delta >= 0, "+").otherwise(""), delta.cast("string"))),
        (F.exists(sentences, lambda s: s.contains("�") | F.lower(s).contains("www.")), "artifact_character"),
        (F.exists(sentences, lambda s: X.count_words(s) > 70), "very_long_sentence"),
        (F.exists(sentences, lambda s: ~X.has_final_mark(s)), "missing_terminal_punctuation"),
        (X.odd_quotes(F.array_join(sentences, " ")), "unbalanced_straight_quotes"),
    )


def compacted(sentences: Column, lesson: Column) -> Column:
    """Sentences numbered in their lesson, then without the blank ones: numbers keep their gaps."""
    every = F.transform(sentences, lambda s, i: F.struct(X.sentence_id(lesson, i + 1).alias("id"), F.trim(s["english"]).alias("english"), F.coalesce(s["chinese"], F.lit("")).alias("chinese")))
    return F.filter(every, lambda s: s["english"] != "")


def built(lessons: DataFrame, order_map: DataFrame | None = None, prefix: str = "RAZ") -> DataFrame:
    """The library: ``id, source_lesson_id, source_id_duplicated, level, title, title_zh, source_name, sentences, sentence_count,
    word_count, status, reasons``.

    ``lessons``: ``row_id, id, level, title, title_zh, sentences, source_name``; lessons of other levels than A to Z are left
    out, as the builder does. Order in a level: configured position, number at the id's end, source, title, first copy.
    ``order_map``: ``order_key`` ("LEVEL:title key"), ``position``.
    """
    last = deduplicated(lessons.select("row_id", "id", "level", "title", "title_zh", "sentences", "source_name"))
    counts = last.groupBy("id").agg(F.count(F.lit(1)).alias("_copies"))
    rows = last.withColumn("level", F.upper("level")).filter(F.col("level").isin(X.LEVELS[1:])).join(counts, "id")
    rows = rows.withColumn("order_key", F.concat_ws(":", "level", X.title_key(F.coalesce("title", F.lit("")))))
    if order_map is None:
        rows = rows.withColumn("position", F.lit(None).cast("int"))
    else:
        rows = rows.join(order_map.select("order_key", "position"), "order_key", "left")
    rows = rows.withColumns({"_at": F.coalesce("position", F.lit(9999)), "_number": X.trailing_number(F.col("id")), "title": F.coalesce("title", F.lit("")), "_first": F.col("first_place.row_id")})
    n = numbered(rows, ["level"], ["_at", "_number", "source_name", "title", "_first"], "_n")
    new = X.lesson_id(F.col("level"), F.coalesce(F.col("position").cast("bigint"), F.col("_n")), prefix)
    out = n.select(
        new.alias("id"), F.col("id").alias("source_lesson_id"), (F.col("_copies") > 1).alias("source_id_duplicated"), "level", "title", F.coalesce("title_zh", F.lit("")).alias("title_zh"), "source_name",
        compacted(F.col("sentences"), new).alias("sentences"), sentence_issues(F.col("sentences")).alias("reasons"),
    )
    word_count = F.aggregate(F.transform("sentences", lambda s: X.count_words(s["english"], X.BUILDER_WORD)), F.lit(0), lambda a, b: a + b)
    return out.withColumns({"sentence_count": F.coalesce(F.size("sentences"), F.lit(0)), "word_count": F.coalesce(word_count, F.lit(0)), "status": F.when(F.size("reasons") > 0, "review").otherwise("pass")})


def duplicate_ids(library: DataFrame) -> DataFrame:
    """``id, n`` of generated ids that aren't unique, which must be none."""
    return library.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def summary(library: DataFrame) -> DataFrame:
    """One row: lessons, passed, in review, sentences, words."""
    return library.agg(F.count(F.lit(1)).alias("lessons"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "review").alias("in_review"), F.sum("sentence_count").alias("sentences"), F.sum("word_count").alias("words"))


def trimmed(sentences: Column, expected: Column, share: float = 0.65) -> Column:
    """Sentences up to a known supplement's heading in the last part, if that brings their words nearer to ``expected``."""
    n = lambda xs: F.aggregate(F.transform(xs, lambda s: X.count_words(s)), F.lit(0), lambda a, b: a + b)
    head = lambda s: F.exists(F.array(*[F.lit(h) for h in X.SUPPLEMENTS]), lambda h: F.startswith(s, h))
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.size(sentences), F.lit(1))), lambda i: head(F.get(sentences, i - 1)) & (i - 1 >= F.size(sentences) * share))
    better = F.filter(spots, lambda i: F.abs(n(F.slice(sentences, 1, i - 1)) - expected) < F.abs(n(sentences) - expected))
    first = F.get(better, F.lit(0))
    return F.when((expected > 0) & (n(sentences) > expected) & first.isNotNull(), F.slice(sentences, 1, first - 1)).otherwise(sentences)


def corrected(lessons: DataFrame, corrections: DataFrame) -> DataFrame:
    """Lessons with verified sentences put in: ``level, title, replace, with`` must match one sentence exactly.

    Adds ``correction``: ``none``, ``applied``, ``already`` (the new sentences are there), ``ambiguous`` or ``missing``. Only
    ``applied`` rows change, so a second run changes nothing. Corrections are few, one per level and title.
    """
    j = lessons.join(corrections.select(F.col("level").alias("_level"), F.col("title").alias("_title"), "replace", "with"), (F.col("level") == F.col("_level")) & (F.col("title") == F.col("_title")), "left")
    texts = F.transform("sentences", lambda s: s["english"])
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size("sentences"), F.lit(1))), lambda i: F.get(texts, i - 1) == F.col("replace"))
    there = F.forall("with", lambda t: F.array_contains(texts, t))
    state = F.when(F.col("replace").isNull(), "none").when(F.size(hits) == 1, "applied").when(F.size(hits) > 1, "ambiguous").when(there, "already").otherwise("missing")
    j = j.withColumn("correction", state).withColumn("_at", F.get(hits, F.lit(0)))
    new = spliced(F.col("sentences"), F.col("_at"), F.transform("with", lambda t: F.get(F.col("sentences"), F.col("_at") - 1).withField("english", t)))
    return j.withColumn("sentences", F.when(F.col("correction") == "applied", new).otherwise(F.col("sentences"))).drop("_level", "_title", "_at", "replace", "with")
