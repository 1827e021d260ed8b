"""Calling engines outside of Spark (speech, page recognition): one client for each task, with attempts and a growing pause."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def called(rows: DataFrame, key: str, value: str, client: Callable[[], Callable[[object], str]], attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """``key, result, error, attempts`` of ``client()(value)`` for every row; one that fails each time comes out with its error.

    ``client`` is made once in every task, so that it may hold a connection. After attempt n the task waits n pauses. What is done
    already should be left out beforehand (:func:`lexiloom.operators.shards.pending`). A null value isn't sent; both are null then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = client()
        for b in batches:
            out: list[tuple[str | None, str | None, int]] = []
            for x in b.column("value").to_pylist():
                result = error = None
                n = 0
                while x is not None and result is None and n < attempts:
                    if n:
                        time.sleep(pause * n)
                    n += 1
                    try:
                        result, error = ask(x), None
                    except Exception as e:  # noqa: BLE001  whatever a client raises is the row's error
                        error = f"{type(e).__name__}: {e}"
                out.append((result, error, n))
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]], names=["key", "result", "error", "attempts"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(value).alias("value")).mapInArrow(run, f"key {kind}, result string, error string, attempts int").withColumnRenamed("key", key)
