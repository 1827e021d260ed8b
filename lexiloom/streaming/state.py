"""The latest state of each key out of a stream of versions, kept in a table; and counts by day with a watermark."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.operators.learner import active_sessions
from lexiloom.operators.ranking import latest
from lexiloom.session import cut
from lexiloom.sources.readers import exists


BUCKETS = 64


def follow(source: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str]):
    """Upsert each micro-batch into the table at ``table``; a batch that comes twice changes nothing. Ends when the source is read.

    The table lies in ``BUCKETS`` folders by the hash of its keys, and a batch rewrites only those it has rows for. They are replaced one
    after the other: who reads meanwhile may see some of a batch.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        new = latest(new, keys, order).select(*batch.columns, "bucket")
        if exists(spark, table):
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            new = new.unionByName(spark.read.parquet(table).filter(F.col("bucket").isin(touched)))
        cut(latest(new, keys, order)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    return source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """Counts by day and kind; rows later than ``late`` are dropped in a stream. ``ts`` must be a timestamp with zone."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


COUNTER = T.StructType([T.StructField("wrong", T.IntegerType()), T.StructField("done", T.BooleanType())])


def fold_attempts(attempts: DataFrame, strikes: int = 3):
    """A stream of ``user_id, word, right`` as ``user_id, word, wrong, status``: each word until it is right or shown.

    The state of a word is two numbers; words that are done ignore what comes later.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        wrong, done = state.get if state.exists else (0, False)
        status = None
        for pdf in frames:
            for right in pdf.sort_values("attempt").right:
                if done:
                    continue
                wrong, done = (wrong, True) if right else (wrong + 1, wrong + 1 >= strikes)
                status = ("correct" if right else "revealed") if done else "wrong"
        state.update((wrong, done))
        if status:
            yield pd.DataFrame([(*key, wrong, status)], columns=["user_id", "word", "wrong", "status"])

    return attempts.groupBy("user_id", "word").applyInPandasWithState(step, "user_id string, word string, wrong int, status string", COUNTER, "update", GroupStateTimeout.NoTimeout)


def once(source: DataFrame, keys: list[str]) -> DataFrame:
    """A stream in which each key goes through once, whoever asks for it again."""
    return source.dropDuplicates(keys)


def live(sessions: DataFrame, students: DataFrame, now: Column) -> DataFrame:
    """A stream of sessions that haven't run out, with their student out of a table."""
    return active_sessions(sessions, students, now)


def collected(source: DataFrame, table: str, checkpoint: str, mode: str = "append"):
    """Append what a stream gives to a table, with the number of its batch; a batch that comes twice is written once."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return source.writeStream.outputMode(mode).foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until(query, condition, every: float = 30.0, most: float = 3600.0) -> bool:
    """Look at a running stream ``every`` so many seconds until ``condition(query)`` holds, then stop it; False if it never did."""
    end = time.monotonic() + most
    while time.monotonic() < end:
        if condition(query):
            query.stop()
            return True
        if query.awaitTermination(every):
            return bool(condition(query))
    return False
