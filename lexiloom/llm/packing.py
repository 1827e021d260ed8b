"""Filling containers of fixed capacity with texts, measured in tokens (problem 8).

Bounded-space online packing: each partition keeps at most ``WINDOWS`` open containers per capacity. A text goes where it
leaves the least room; if it fits nowhere and no further container may be opened, the fullest is closed. What is still
open at the end of a partition is merged within groups of partitions.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import cut

WINDOWS = 64
#: Partitions whose open containers are merged together; with WINDOWS this bounds a merging task.
MERGED = 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizing pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Packer:
    """Containers of one capacity; :meth:`add` returns the container's number, :attr:`closed` the numbers that take no more."""

    def __init__(self, capacity: int, windows: int = WINDOWS):
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, int]] = []  # room, number; by room
        self.count = 0

    def add(self, size: int) -> int:
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            room, number = self.open.pop(i)
        else:
            if len(self.open) >= self.windows:
                self.open.pop(0)
            room, number = self.capacity, self.count
            self.count += 1
        if room > size:
            insort(self.open, (room - size, number))
        return number


def pieces(size: int, capacity: int) -> Iterator[tuple[int, int]]:
    """``start, length``: the whole text, or parts of it if it exceeds the capacity."""
    for start in range(0, max(size, 1), capacity):
        yield start, min(capacity, size - start)


_PLACED = "target_id int, part int, number int, doc_id bigint, piece int, token_start int, n_tokens int, open boolean"
_KIND = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in _PLACED.split(", "))])


def packed(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, windows: int = WINDOWS) -> DataFrame:
    """``target_id, container_id, doc_id, piece, token_start, n_tokens`` of every piece of every text, for each capacity.

    ``targets`` is a small table of capacities (300 at most, else an error). A text is split only if it exceeds the
    capacity by itself, then into full containers and a rest. Null and empty texts have no tokens: they come out once per
    target with a null ``container_id``. Capacities below 1 and null are refused.
    """
    goals = [(r[0], r[1]) for r in targets.select("target_id", "capacity_tokens").limit(301).collect()]
    if len(goals) > 300 or any(c is None or c < 1 for _, c in goals):
        raise ValueError("pack targets: at most 300, each with a capacity of one token or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        packers = {t: Packer(c, windows) for t, c in goals}
        waiting: dict[tuple[int, int], list[tuple]] = {}
        done: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                size = len(enc.encode_ordinary(text)) if text else 0
                for t, capacity in goals:
                    if not size:
                        done.append((t, part, None, doc, 0, 0, 0, False))
                        continue
                    p = packers[t]
                    for k, (start, n) in enumerate(pieces(size, capacity)):
                        waiting.setdefault((t, p.add(n)), []).append((doc, k, start, n))
            for t, p in packers.items():
                alive = {n for _, n in p.open}
                for key in [k for k in waiting if k[0] == t and k[1] not in alive]:
                    done += [(t, part, key[1], *row, False) for row in waiting.pop(key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(_KIND)], schema=_KIND)
            done = []
        rest = [(t, part, n, *row, True) for (t, n), rows in waiting.items() for row in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rest], f.type) for i, f in enumerate(_KIND)], schema=_KIND)

    capacity = dict(goals)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "part", "number"], ascending=[False, True, True])
        p = Packer(capacity[int(pdf.target_id.iloc[0])], len(pdf))
        first: dict[int, tuple[int, int]] = {}
        into = [first.setdefault(p.add(int(u)), (int(a), int(n))) for u, a, n in zip(pdf.used, pdf.part, pdf.number)]
        return pd.DataFrame({"target_id": pdf.target_id, "part": pdf.part, "number": pdf.number, "to_part": [a for a, _ in into], "to_number": [n for _, n in into]})

    placed = cut(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _PLACED))
    windows_left = placed.filter("open").groupBy("target_id", "part", "number").agg(F.sum("n_tokens").alias("used"))
    moved = windows_left.groupBy("target_id", F.floor(F.col("part") / MERGED).alias("g")).applyInPandas(lambda pdf: merge(pdf), "target_id int, part int, number int, to_part int, to_number int")
    last = placed.filter("open").join(moved, ["target_id", "part", "number"])
    name = lambda a, b: F.concat_ws("-", a, b)
    columns = ["doc_id", "piece", "token_start", "n_tokens"]
    return (
        placed.filter("not open").select("target_id", F.when(F.col("number").isNotNull(), name("part", "number")).alias("container_id"), *columns)
        .unionByName(last.select("target_id", name("to_part", "to_number").alias("container_id"), *columns))
    )


def fill(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens and the share of the room that is used."""
    c = packed(documents, targets).filter("container_id is not null").groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_pieces"))
    j = c.join(F.broadcast(targets.select("target_id", "target_name", "capacity_tokens")), "target_id")
    return j.groupBy("target_id", "target_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_pieces").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("most"), (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("fill_share"))


def checked(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per capacity: documents, those without tokens, and what must be none: containers that hold too much, documents in several
    pieces although they fit, documents whose pieces don't follow one another."""
    p = cut(packed(documents, targets))
    limit = F.broadcast(targets.select("target_id", "capacity_tokens"))  # 300 at most, see packed()
    docs = p.groupBy("target_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count_distinct("piece").alias("pieces"), F.count("container_id").alias("held"))
    d = docs.join(limit, "target_id").groupBy("target_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("held") == 0).alias("empty"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("needless"),
        F.count_if((F.col("end") != F.col("tokens")) | (F.col("pieces") != F.col("n"))).alias("gaps"),
    )
    full = p.filter("container_id is not null").groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("used")).join(limit, "target_id")
    return d.join(full.groupBy("target_id").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull")), "target_id", "left").select("target_id", "documents", "empty", F.coalesce("overfull", F.lit(0)).alias("overfull"), "needless", "gaps")
