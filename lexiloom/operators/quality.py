"""Quality gates over clips, sampled checks, failure reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.functions.numeric import guarded_ratio
from lexiloom.operators.catalog import top_per_group
from lexiloom.operators.ranking import evenly_spaced

#: Least coverage, shortest and longest clip, least mean score, contamination by a neighbour.
COVERAGE, SHORTEST, LONGEST, MEAN, CONTAMINATION = 0.90, 0.45, 90.0, 0.80, 0.08


def quality_gate(clips: DataFrame, confidence: float = 0.55, weak_share: float = 0.15) -> DataFrame:
    """Per ``key``: clips, word coverage, weak and implausible clips, and whether the lesson passes.

    ``clips``: ``key, expected, matched, confidence, duration``. One aggregation; every measure is a partial sum.
    """
    weak, odd = F.count_if(F.col("confidence") < confidence), F.count_if((F.col("duration") < SHORTEST) | (F.col("duration") > LONGEST))
    g = clips.groupBy("key").agg(F.count(F.lit(1)).alias("clips"), guarded_ratio(F.sum("matched"), F.sum("expected")).alias("coverage"), weak.alias("weak"), odd.alias("implausible"))
    return g.withColumn("weak_ratio", guarded_ratio(F.col("weak"), F.col("clips"))).withColumn("passed", (F.col("coverage") >= COVERAGE) & (F.col("weak_ratio") <= weak_share) & (F.col("implausible") == 0))


def sampled(clips: DataFrame, count: int = 8, weakest: int = 2) -> DataFrame:
    """Clips to check: evenly spaced ones of each ``key`` by ``pos`` and the ``weakest`` by ``confidence``."""
    even = evenly_spaced(clips, ["key"], ["pos"], count)
    low = top_per_group(clips, ["key"], [F.col("confidence"), F.col("pos")], weakest)
    return even.unionByName(low).dropDuplicates(["key", "pos"])


def sample_gate(scores: DataFrame, least: float = 0.72, failures: float = 0.0) -> DataFrame:
    """Per ``key`` the checked clips, failures, mean score, and whether it passes."""
    g = scores.groupBy("key").agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("score") < least).alias("failed"), F.avg("score").alias("mean_score"))
    g = g.withColumn("failure_ratio", F.col("failed") / F.col("sampled"))
    return g.withColumn("passed", (F.col("failure_ratio") <= failures) & (F.col("mean_score") >= MEAN))


def contaminated(scored: DataFrame, least: float = 0.72) -> DataFrame:
    """Clips of a ``key`` by ``pos`` that sound more like the sentence before or behind.

    ``scored``: ``key, pos, score, previous_score, next_score`` (null at the ends).
    """
    other = F.greatest(F.coalesce("previous_score", F.lit(0.0)), F.coalesce("next_score", F.lit(0.0)))
    bad = other > F.col("score") + CONTAMINATION
    return scored.withColumn("contaminated", bad).withColumn("passed", (F.col("score") >= least) & ~bad)


def strict(heard: DataFrame) -> DataFrame:
    """``exact``: whether the words heard are the words expected, blanks, marks and case aside; an empty sentence never passes.

    ``heard``: ``expected, heard`` as texts; null is unlike anything.
    """
    a, b = (F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in ("expected", "heard"))
    exact = F.coalesce(a == b, F.lit(False))
    return heard.withColumn("exact", exact).withColumn("passed", exact & (F.coalesce(a, F.lit("")) != ""))


def split_by_gate(df: DataFrame, gate: str = "passed") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; a null gate rejects."""
    ok = F.coalesce(F.col(gate), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def failures(results: DataFrame) -> DataFrame:
    """``id, level, reason, error`` of failed results; ``results``: ``id, status, error``."""
    error = F.coalesce("error", F.lit(""))
    return results.filter(F.col("status") == "failed").select("id", X.id_part(F.col("id"), 2).alias("level"), X.failure_reason(error).alias("reason"), error.alias("error"))


def status_by_level(results: DataFrame) -> DataFrame:
    """``level, status, n``; finished and skipped ones count as usable."""
    status = F.when(F.col("status").isin("complete", "skipped-existing"), "usable").otherwise(F.coalesce("status", F.lit("unknown")))
    return results.groupBy(X.id_part(F.col("id"), 2).alias("level"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def stratified(rows: DataFrame, stratum: str, order: list, count: int = 10) -> DataFrame:
    """``count`` evenly spaced rows of each stratum."""
    return evenly_spaced(rows, [stratum], order, count)


def risky(failed: DataFrame, implausible: DataFrame, weak: DataFrame) -> DataFrame:
    """The union of three sets of ``id``."""
    return failed.select("id").union(implausible.select("id")).union(weak.select("id")).distinct()
