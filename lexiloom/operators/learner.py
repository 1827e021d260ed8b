"""Learners: attempts, vocabulary, study days, progress, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.functions.numeric import percent
from lexiloom.session import join_small

STATE = "vocabulary array<struct<word:string,source:string,addedAt:bigint,correct:int,attempts:int>>, progress map<string,struct<completed:int,total:int,updatedAt:bigint>>, totalSentences int, studyDays array<string>, selectedLevel string"
#: Fixed value: wrong attempts in a row after which a word is shown.
STRIKES = 3


def states(documents: DataFrame) -> DataFrame:
    """State documents as columns, with empty members in place of missing ones; unreadable documents are left out."""
    s = documents.withColumn("_s", F.from_json("state_json", STATE)).filter("state_json is not null and try_parse_json(state_json) is not null")
    level = F.when(F.col("_s.selectedLevel").isin(X.LEVELS), F.col("_s.selectedLevel")).otherwise("A")
    return s.select(
        "row_id", "user_id", "updated_at",
        F.coalesce("_s.vocabulary", F.array().cast("array<struct<word:string,source:string,addedAt:bigint,correct:int,attempts:int>>")).alias("vocabulary"),
        F.coalesce("_s.progress", F.create_map().cast("map<string,struct<completed:int,total:int,updatedAt:bigint>>")).alias("progress"),
        F.coalesce("_s.totalSentences", F.lit(0)).alias("total_sentences"), F.coalesce("_s.studyDays", F.array().cast("array<string>")).alias("study_days"), level.alias("level"),
    )


def runs(days: DataFrame, user: str = "user_id", day: str = "day") -> DataFrame:
    """``user, first, last, length`` of each run of days in a row; repeated days count once."""
    w = W.partitionBy(user).orderBy(day)
    d = days.select(user, day).distinct().withColumn("_i", F.row_number().over(w))
    return d.groupBy(user, F.date_sub(day, F.col("_i")).alias("_g")).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")


def streak(days: DataFrame, today: Column, user: str = "user_id", day: str = "day") -> DataFrame:
    """Days in a row up to ``today`` for each user with any day; 0 if today isn't among them."""
    r = runs(days, user, day)
    return r.groupBy(user).agg(F.coalesce(F.max(F.when((F.col("first") <= today) & (F.col("last") >= today), F.datediff(today, "first") + 1)), F.lit(0)).alias("streak"))


def outcomes(attempts: DataFrame, key: list[str], order: list[str], strikes: int = STRIKES) -> DataFrame:
    """Per word ``wrong`` attempts before it was right or shown, and ``status``: correct, revealed or wrong.

    ``attempts`` has ``right``; what comes after is ignored. Two aggregations with partial sums and a join by key, so that a
    word with any number of attempts is spread.
    """
    rank = F.struct(*order)
    hits = attempts.filter("right").groupBy(*key).agg(F.min(rank).alias("_hit"))
    j = join_small(attempts.filter("not right"), hits, key, "left").filter(F.col("_hit").isNull() | (rank < F.col("_hit")))
    misses = j.groupBy(*key).agg(F.count(F.lit(1)).alias("_misses"))
    g = attempts.select(*key).distinct().join(hits, key, "left").join(misses, key, "left")
    wrong = F.least(F.coalesce("_misses", F.lit(0)), F.lit(strikes)).cast("int")
    status = F.when(wrong >= strikes, "revealed").when(F.col("_hit").isNotNull(), "correct").otherwise("wrong")
    return g.select(*key, wrong.alias("wrong"), status.alias("status"))


def vocabulary(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Words with where they were first met, right answers, attempts, and mastery (right answers, five at most)."""
    g = events.groupBy(*key).agg(F.min_by("source", F.struct(*order)).alias("source"), F.min(F.struct(*order)).alias("_first"), F.count_if("right").alias("correct"), F.count(F.lit(1)).alias("attempts"))
    return g.withColumns({"mastery": F.least(F.lit(5), F.col("correct")), "added": F.col("_first")[order[0]]}).drop("_first")


def progress(lessons: DataFrame, done: DataFrame) -> DataFrame:
    """``lesson_id, total, completed, percent`` of every lesson; ``done``: ``lesson_id, position``, of which the farthest counts."""
    far = done.groupBy("lesson_id").agg(F.max("position").alias("_far"))
    j = lessons.join(far, "lesson_id", "left").withColumn("completed", F.coalesce("_far", F.lit(0)))
    return j.select("lesson_id", "total", "completed", percent(F.col("completed"), F.col("total")).alias("percent"))


def active_sessions(sessions: DataFrame, students: DataFrame, now: Column) -> DataFrame:
    """Sessions that haven't run out, with their student. Students delivered twice count once."""
    known = students.groupBy("id").agg(F.min("username").alias("username"), F.min("display_name").alias("display_name"))
    live = sessions.filter(F.col("expires_at") > now).select("token", "user_id", "expires_at")
    return live.join(known, live["user_id"] == known["id"]).select("token", "user_id", "username", "display_name", "expires_at")


def first_level(states_: DataFrame, lessons: DataFrame) -> DataFrame:
    """``user_id, level``: the saved level if it has lessons, else the first that has any."""
    have = lessons.select(F.col("level").alias("_have")).distinct()
    known = have.filter(F.col("_have").isin(X.LEVELS))  # as many as there are levels
    first = min((r[0] for r in known.collect()), key=X.LEVELS.index, default=None)
    return states_.join(F.broadcast(known), F.col("level") == F.col("_have"), "left").select("user_id", F.coalesce("_have", F.lit(first)).alias("level"))


def with_fallback(sentences: DataFrame, clips: DataFrame) -> DataFrame:
    """``url`` and where it is from: a clip of the recording, else the server."""
    j = sentences.join(clips.select("sentence_id", "url"), "sentence_id", "left")
    return j.withColumn("mode", F.when(F.col("url").isNotNull(), "clip").otherwise("server"))
