"""Held-out passages inside a corpus (problem 9).

The word n-grams of the held-out items form a hash set that every task gets. Each document's word windows are hashed with
a rolling hash and looked up in it; every hit is verified word by word. An item set too large for one hash set is taken
in blocks, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.words import Hashes, rolling, spans, words

N = 12
#: Characters of held-out text in one block, which bounds what is broadcast.
BLOCK_CHARS = 8_000_000
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("begin_char", pa.int32()), ("end_char", pa.int32()), ("n_words", pa.int32())]))
_HITS = "hits array<struct<item_id:bigint,begin_char:int,end_char:int,n_words:int>>"


class Grams:
    """The n-grams of some items, sorted by hash; ``text`` and ``word`` say where each stands, ``items`` has the item of each text.

    An item may have several texts.
    """

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.items, self.texts, hashes = n, [item for item, _ in items], [words(text) for _, text in items], Hashes()
        keys, text, word = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for t, own in enumerate(self.texts):
            h = rolling(np.fromiter((hashes[w] for w in own), dtype=np.uint64, count=len(own)), n)
            keys.append(h)
            text.append(np.full(len(h), t, np.int32))
            word.append(np.arange(len(h), dtype=np.int32))
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        self.keys, self.text, self.word = flat[order], np.concatenate(text)[order], np.concatenate(word)[order]

    def hits(self, own: list[str], hashes: Hashes) -> dict[int, list[int]]:
        """By item, the word positions at which one of its n-grams begins."""
        out: dict[int, list[int]] = {}
        h = rolling(np.fromiter((hashes[w] for w in own), dtype=np.uint64, count=len(own)), self.n)
        lo = np.searchsorted(self.keys, h, "left")
        at = np.flatnonzero((lo < len(self.keys)) & (self.keys[np.minimum(lo, len(self.keys) - 1)] == h)) if len(self.keys) else []
        for i in np.asarray(at).tolist():
            k = int(lo[i])
            while k < len(self.keys) and self.keys[k] == h[i]:
                t, p = int(self.text[k]), int(self.word[k])
                if self.texts[t][p : p + self.n] == own[i : i + self.n]:
                    starts = out.setdefault(self.items[t], [])
                    if not starts or starts[-1] != i:
                        starts.append(i)
                k += 1
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null and text is not null").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def places(text: str) -> list[tuple[int, int]]:
    """Where each word lies in the text itself, whatever lower-casing does to its length."""
    at = spans(text)[1]
    if text.isascii() or len(text.lower()) == len(text):
        return at
    ends = np.cumsum([len(c.lower()) for c in text])  # of each character in the lower-cased text
    return [(int(np.searchsorted(ends, b, "right")), int(np.searchsorted(ends, e - 1, "right")) + 1) for b, e in at]


def _marked(documents: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``doc_id, text, hits`` of every document: all longest spans covered by n-grams of an item. One scan of the corpus; every block
    of items is one more pass over the rows on their way."""
    spark = documents.sparkSession
    out = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.array().cast(_HITS.partition(" ")[2]).alias("hits"))
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(Grams(block, n))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            grams, hashes = shared.value, Hashes()
            for b in batches:
                rows = b.column("hits").to_pylist()
                for k, text in enumerate(b.column("text").to_pylist()):
                    own = words(text)
                    found = grams.hits(own, hashes)
                    at = places(text) if found else []
                    for item, starts in found.items():
                        first = last = starts[0]
                        for s in [*starts[1:], None]:
                            if s is None or s > last + n:
                                rows[k].append({"item_id": item, "begin_char": at[first][0], "end_char": at[last + n - 1][1], "n_words": last + n - first})
                                first = s
                            last = s
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(rows, _HIT)], names=["doc_id", "text", "hits"])

        out = out.mapInArrow(run, f"doc_id bigint, text string, {_HITS}")
    return out


def leaks(documents: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """``doc_id, item_id, begin_char, end_char, n_words``: every longest span of a document covered by n-grams of an item.

    Null texts and texts of fewer than ``n`` words have none; items with the same id count as one; repeated documents each
    come out. Other columns are ignored.
    """
    return _marked(documents.filter("text is not null"), items, n).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of every document with at least twelve consecutive words of an item."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Each held-out item with the number of documents that contain some of it, 0 included."""
    hits = found(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.select("item_id", "split_name").join(hits, "item_id", "left").select("item_id", "split_name", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def cleaned(documents: DataFrame, items: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """``doc_id, text, removed_chars, dropped``: documents without the leaked spans, cut in the pass that finds them.

    A document of which the spans cover ``drop_share`` or more is dropped as a whole (``text`` null, ``dropped`` true). Null texts
    stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, hits in zip(b.column("text").to_pylist(), b.column("hits").to_pylist()):
                kept, at, gone = [], 0, 0
                for begin, end in sorted((h["begin_char"], h["end_char"]) for h in hits):
                    begin = max(at, begin)
                    if end > begin:
                        kept.append(t[at:begin])
                        gone += end - begin
                        at = end
                whole = bool(gone) and gone >= drop_share * len(t)
                out.append((None if whole or t is None else "".join([*kept, t[at:]]), gone, whole))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.bool_()))]], names=["doc_id", "text", "removed_chars", "dropped"])

    return _marked(documents, items, N).mapInArrow(run, "doc_id bigint, text string, removed_chars int, dropped boolean")
