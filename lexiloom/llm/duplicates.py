"""Records that differ only in white space, letter case, punctuation or member order (problem 7).

Each record gets canonical bytes. Equal bytes are first combined inside every input partition, so a key that holds a third
of all rows travels as one partial count per batch. The partial counts are then partitioned by radix: buckets by the first
bytes, and a bucket with too many entries is split by its next bytes, again and again, until each fits. Every bucket is
counted in a trie whose terminal nodes carry the counters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.session import cut, fits_broadcast, join_small

#: Bytes by which a bucket is told apart at each further depth.
STEP = 2


def canonical(*columns: str) -> Column:
    """Lower case without white space and punctuation; the columns stay apart by U+0000. Null if any of them is null."""
    return F.concat(*[x for i, c in enumerate(columns) for x in ([F.lit("\0")] if i else []) + [F.regexp_replace(F.lower(c), r"(?U)[\s\p{P}\x1C-\x1F]+", "")]])


def canonical_json(text: str | None) -> str | None:
    """JSON with its members in order; text that is unreadable, or nested deeper than the reader goes, stays as it is."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")) if text else text
    except (ValueError, RecursionError):
        return text


_PART = pa.schema([("key", pa.string()), ("copies", pa.int64()), ("first", pa.int64())])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pa.Table.from_batches([b]).group_by("key").aggregate([("first", "count"), ("first", "min")])
        yield from t.select(["key", "first_count", "first_min"]).rename_columns(["key", "copies", "first"]).cast(_PART).to_batches()


def splits(partial: DataFrame, capacity: int) -> dict[bytes, int]:
    """The prefixes whose buckets hold more than ``capacity`` entries, and the length at which the next bytes split each of them.

    Bytes that all entries of a bucket share are skipped, so that each round parts a bucket or leaves it for good: one that is
    a single key can't be split. At most entries / capacity prefixes are large in a round, which bounds what the driver gets.
    """
    large: dict[bytes, int] = {}
    while True:
        sized = partial.select("key").mapInArrow(_bucketed(large), "bucket binary, key string").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        found = sized.filter((F.col("n") > capacity) & (F.col("lo") != F.col("hi"))).select("bucket", "lo", "hi").collect()
        new = {}
        for bucket, lo, hi in found:
            a, b = lo.encode("utf-8", "surrogatepass"), hi.encode("utf-8", "surrogatepass")
            shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if bytes(bucket) not in large:
                new[bytes(bucket)] = max(shared, len(bucket)) + STEP
        if not new:
            return large
        large |= new


def _bucketed(large: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key in b.column("key").to_pylist():
                raw, n = key.encode("utf-8", "surrogatepass"), STEP
                while len(raw) > n and (longer := large.get(raw[:n])):
                    n = longer
                out.append(raw[:n])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *b.columns], names=["bucket", *b.schema.names])

    return run


class Trie:
    """A trie over strings in pieces of eight characters; ``None`` in a node is its terminal counter."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, copies: int, first: int) -> None:
        node = self.root
        for i in range(0, len(key), 8):
            node = node.setdefault(key[i : i + 8], {})
        if None in node:
            node[None][0] += copies
            node[None][1] = min(node[None][1], first)
        else:
            node[None] = [copies, first]

    def __iter__(self) -> Iterator[tuple[str, int, int]]:
        stack = [("", self.root)]
        while stack:
            at, node = stack.pop()
            for k, v in node.items():
                if k is None:
                    yield at, v[0], v[1]
                else:
                    stack.append((at + k, v))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, trie = None, Trie()

    def out() -> Iterator[pa.RecordBatch]:
        rows = list(trie)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PART)], schema=_PART)

    for b in batches:
        for at, key, copies, first in zip(*[b.column(c).to_pylist() for c in ("bucket", "key", "copies", "first")]):
            if at != bucket:
                yield from out()
                bucket, trie = at, Trie()
            trie.add(key, copies, first)
    yield from out()


def counted(df: DataFrame, key: Column, row: str, capacity: int = 50_000, buckets: int = 4096) -> DataFrame:
    """``key, copies, first`` (the smallest ``row``) of every distinct canonical key; null keys are left out.

    ``capacity`` is the least number of entries worth a bucket of its own; it rises with the data so that at most
    ``buckets`` prefixes of one length are split.
    """
    partial = cut(df.select(key.alias("key"), F.col(row).cast("bigint").alias("first")).filter("key is not null").mapInArrow(_combined, "key string, copies bigint, first bigint"))
    capacity = max(capacity, -(-partial.count() // buckets))
    large = splits(partial, capacity)
    placed = partial.mapInArrow(_bucketed(large), "bucket binary, key string, copies bigint, first bigint")
    return placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted, "key string, copies bigint, first bigint")


def members(df: DataFrame, key: Column, row: str, hot: int = 512) -> DataFrame:
    """``first, row, copies`` for each row of a group of two or more.

    Groups with more than one in ``hot`` of all grouped rows number less than ``hot``; they are broadcast if their keys are short
    enough, so that their rows aren't shuffled; else both sides are salted. The other groups join by key.
    """
    groups = cut(counted(df, key, row).filter("copies > 1"))
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    rows = df.select(key.alias("key"), F.col(row).cast("bigint").alias("row")).filter("key is not null")
    large = groups.filter(F.col("copies") > F.lit(max(1000, total // hot)))
    if not fits_broadcast(large):  # very long keys
        return join_small(rows, groups, "key").select("first", "row", "copies")
    large = F.broadcast(large)
    few = rows.join(large.select("key"), "key", "left_anti").join(groups, "key")
    return rows.join(large, "key").unionByName(few).select("first", "row", "copies")


def pairs(library: DataFrame) -> DataFrame:
    """``row_id_a, row_id_b``: the smallest row of each group of equal level and title with each other row of it.

    Rows with a null level or title belong to no group. A level or title of nothing but punctuation equals any other such.
    """
    m = members(library, canonical("level", "title"), "row_id")
    return m.filter("row != first").select(F.col("first").alias("row_id_a"), F.col("row").alias("row_id_b"))


def collapsed(library: DataFrame) -> DataFrame:
    """One record per lesson (its smallest row), with its copies and the number of different sentence documents.

    Documents that differ in member order only are the same. A record with a null level or title stays by itself.
    """
    body = F.pandas_udf(lambda s: s.map(canonical_json), "string")
    alone = library.filter("level is null or title is null").select("row_id", F.lit(1).cast("bigint").alias("copies"))
    groups = counted(library, canonical("level", "title"), "row_id")
    key = canonical("level", "title")
    contents = (
        library.filter("level is not null and title is not null")
        .select(key.alias("key"), F.xxhash64(body("sentences_json")).alias("content"))
        .groupBy("key", "content").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("contents"))
    )
    lessons = groups.join(contents, "key").select(F.col("first").alias("row_id"), "copies", "contents").unionByName(alone.withColumn("contents", F.lit(1).cast("bigint")))
    return lessons.join(library.select("row_id", "id", "level", "title", "source_name"), "row_id")
