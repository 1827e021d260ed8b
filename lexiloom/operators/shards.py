"""Merging the results of shards, and tables where the last row of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.ranking import latest


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; of several new rows the last by ``order``.

    Columns of ``old`` that ``new`` lacks become null in its rows. Null keys count as equal.
    """
    rows = latest(new, keys, order) if order else new.dropDuplicates(keys)
    on = None
    for k in keys:
        same = old[k].eqNullSafe(rows[k])
        on = same if on is None else on & same
    return old.join(rows, on, "left_anti").unionByName(rows.select(*[c for c in old.columns if c in rows.columns]), allowMissingColumns=True)


def deleted(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def merged_results(official: DataFrame, shards: DataFrame) -> DataFrame:
    """``lesson_id`` results of all shards over the official ones; a later shard wins. ``shards`` has ``shard`` besides."""
    rest = [c for c in official.columns if c != "lesson_id"]
    every = official.withColumn("shard", F.lit(-1)).unionByName(shards)
    return every.groupBy("lesson_id").agg(F.max_by(F.struct(*rest), "shard").alias("_r")).select("lesson_id", "_r.*")


def merged_index(official: DataFrame, shards: DataFrame, shard_results: DataFrame, sentences: DataFrame) -> DataFrame:
    """``sentence_id, url``: the official index without the sentences of every lesson that failed in any shard, overlaid with the
    indexes of the shards, later ones last. A failure isn't taken back by a later success; only a shard's index is.

    ``shards``: ``sentence_id, url, shard``; ``sentences``: ``lesson_id, sentence_id``.
    """
    failed = shard_results.filter(F.col("status") == "failed").select("lesson_id").distinct()
    stale = sentences.join(failed, "lesson_id", "left_semi").select("sentence_id")
    kept = official.join(stale, "sentence_id", "left_anti").select("sentence_id", "url", F.lit(-1).alias("shard"))
    return kept.unionByName(shards.select("sentence_id", "url", "shard")).groupBy("sentence_id").agg(F.max_by("url", "shard").alias("url"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet."""
    return work.join(done.select(*keys), keys, "left_anti")


def valid_cache(work: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Work with the cached row whose keys (path, size, time, version) all agree; null where it must be computed anew."""
    return work.join(cache, keys, "left")


def missing_keys(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Keys that a mandatory lookup would miss, which must be none."""
    return rows.join(dimension, key, "left_anti").select(key).distinct()


def zip_mismatches(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Positions at which two lists of ``value`` by ``keys`` differ, or one is longer; none if they agree."""
    j = left.select(*keys, F.col(value).alias("left_value")).join(right.select(*keys, F.col(value).alias("right_value")), keys, "full")
    return j.filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def promoted(candidates: DataFrame, clips: DataFrame, sentences: DataFrame, existing: DataFrame) -> DataFrame:
    """``lesson_id, problem``: null where a candidate may be published.

    All its clips must be valid, as many as there are sentences, with the same ids, and the lesson not yet published.
    ``clips``: ``lesson_id, sentence_id, passed``; ``sentences``: ``lesson_id, sentence_id``; ``existing``: ``lesson_id``.
    """
    c = clips.groupBy("lesson_id").agg(F.count(F.lit(1)).alias("clips"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("valid"))
    j = sentences.select("lesson_id", "sentence_id").join(clips.select("lesson_id", "sentence_id", F.lit(1).alias("have")).distinct(), ["lesson_id", "sentence_id"], "left")
    s = j.groupBy("lesson_id").agg(F.count(F.lit(1)).alias("sentences"), F.count("have").alias("matched"))
    out = candidates.select("lesson_id").join(c, "lesson_id", "left").join(s, "lesson_id", "left").join(existing.select("lesson_id", F.lit(True).alias("there")).distinct(), "lesson_id", "left")
    problem = F.when(F.col("there"), "exists").when(F.col("clips").isNull() | ~F.col("valid"), "invalid clips").when(~F.col("clips").eqNullSafe(F.col("sentences")), "count").when(F.col("matched") != F.col("sentences"), "ids")
    return out.select("lesson_id", problem.alias("problem"))
