"""Choosing rows: optional filters, exact lookups, work that failed or is complete, orders given by lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen(rows: DataFrame, least: float | None = None, by: str = "score", **sets: list | None) -> DataFrame:
    """Rows whose columns lie in the given sets and whose ``by`` reaches ``least``; an empty or absent set doesn't filter."""
    out = rows
    for column, values in sets.items():
        if values:
            out = out.filter(F.col(column).isin(list(values)))
    return out if least is None else out.filter(F.col(by) >= least)


def the_one(rows: DataFrame, condition: Column) -> DataFrame:
    """The single row for which ``condition`` holds; an error if there is none or another."""
    found = rows.filter(condition).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{len(found) or 'no'} row{'s' * (len(found) > 1)} for {condition}")
    return rows.filter(condition)


def first_or_none(rows: DataFrame, *order: Column | str):
    return rows.orderBy(*order).first() if order else rows.first()


def attempted(rows: DataFrame, result: str, error: str) -> tuple[DataFrame, DataFrame]:
    """Rows that came out, and those with an error (without a result column)."""
    return rows.filter(F.col(error).isNull()).drop(error), rows.filter(F.col(error).isNotNull()).drop(result)


def complete(expected: DataFrame, files: DataFrame) -> DataFrame:
    """``lesson_id, complete``: whether as many outputs are there as expected, under the expected names.

    ``expected``: ``lesson_id, name``; ``files``: ``lesson_id, name``. Lessons that expect nothing aren't listed.
    """
    j = expected.select("lesson_id", "name").distinct().join(files.select("lesson_id", "name", F.lit(1).alias("there")).distinct(), ["lesson_id", "name"], "left")
    extra = files.select("lesson_id", "name").distinct().join(expected.select("lesson_id", "name"), ["lesson_id", "name"], "left_anti").groupBy("lesson_id").agg(F.count(F.lit(1)).alias("extra"))
    done = j.groupBy("lesson_id").agg((F.count("there") == F.count(F.lit(1))).alias("all"))
    return done.join(extra, "lesson_id", "left").select("lesson_id", (F.col("all") & F.col("extra").isNull()).alias("complete"))


def in_order_of(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows in the order of a list; others last, by the column itself."""
    at = F.array_position(F.lit(values), F.col(column))
    return rows.orderBy(F.when(at > 0, at).otherwise(F.lit(len(values) + 1)), column)


def by_frequency(rows: DataFrame, column: str, first: str) -> DataFrame:
    """``column, n`` most frequent first; of equal ones the one met first."""
    g = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("_first"))
    return g.orderBy(F.desc("n"), "_first").drop("_first")


def best_by_score(rows: DataFrame, *parts: tuple[Column, float]) -> DataFrame:
    """The row with the highest sum of the scores of the conditions that hold."""
    score = sum((F.when(c, F.lit(float(s))).otherwise(F.lit(0.0)) for c, s in parts), F.lit(0.0))
    return rows.withColumn("score", score).orderBy(F.desc("score"), *rows.columns).limit(1)


def cyclic_next(position: Column, size: Column) -> Column:
    return F.pmod(position + 1, F.greatest(size, F.lit(1)))
