"""Repetition inside single documents (problem 10): rolling hashes of several n-gram lengths, in numpy.

Every measure is the share of a document that lies in n-grams, or lines, which occurred before in the same document. A
repeated hash counts only after the words behind it were compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.fsm import slices
from lexiloom.llm.words import rolling, words

LENGTHS = (2, 4, 6, 10)
#: Words of a run, and tenths of a document's words in such runs, at which it counts as repetitive.
FOUND_LENGTH, FOUND_TENTHS = 6, 3


def repeated(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each code, whether it lies in a run of n codes that also begins earlier in the text of the same owner.

    All texts of a batch lie end to end; runs that reach into the next text don't count. The two runs may overlap.
    """
    cover = np.zeros(len(codes), dtype=bool)
    if len(codes) <= n:
        return cover
    inside = np.flatnonzero(owner[: len(codes) - n + 1] == owner[n - 1 :])
    with np.errstate(over="ignore"):
        h = (rolling(codes, n)[inside] ^ (owner[inside].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))) * np.uint64(0x9FB21C651E98DF25)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    later, before = inside[order[same + 1]], inside[order[same]]
    ok = owner[later] == owner[before]
    for j in range(n):  # each hit against the one before it; equal hashes of unequal words are dropped
        ok &= codes[later + j] == codes[before + j]
    later = later[ok]
    edges = np.bincount(later, minlength=len(codes) + 1) - np.bincount(later + n, minlength=len(codes) + 1)
    return np.cumsum(edges[:-1]) > 0


def _line_share(text: str | None) -> float:
    """The share of characters in lines that occurred before; blank lines don't count."""
    if not text or "\n" not in text:
        return 0.0
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    seen: set[str] = set()
    again = 0
    for x in lines:
        if x in seen:
            again += len(x)
        seen.add(x)
    return again / max(1, sum(map(len, lines)))


def measures(texts: list[str | None], lengths: tuple[int, ...] = LENGTHS) -> list[np.ndarray]:
    """By text ``n_words``, covered words and share of word characters for each length, and the share of repeated lines."""
    own = [words(t) for t in texts]
    counts = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    flat = [w for ws in own for w in ws]
    seen: dict[str, int] = {}
    with np.errstate(over="ignore"):  # words as numbers, equal if and only if the words are, spread over 64 bits
        codes = (np.fromiter((seen.setdefault(w, len(seen)) for w in flat), dtype=np.uint64, count=len(flat)) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    size = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    owner = np.repeat(np.arange(len(own)), counts)
    total = np.maximum(np.bincount(owner, weights=size, minlength=len(own)), 1)
    out = [counts]
    for n in lengths:
        c = repeated(codes, owner, n)
        out += [np.bincount(owner[c], minlength=len(own)), np.bincount(owner[c], weights=size[c], minlength=len(own)) / total]
    return [*out, np.array([_line_share(t) for t in texts], dtype=float)]


def measure(text: str | None) -> tuple:
    return tuple(x[0].item() for x in measures([text]))


_FIELDS = [("n_words", pa.int32()), *[f for n in LENGTHS for f in ((f"words_{n}", pa.int32()), (f"share_{n}", pa.float64()))], ("line_share", pa.float64())]
_KIND = pa.schema([("doc_id", pa.int64()), *_FIELDS])
_SQL = "doc_id bigint, n_words int, " + ", ".join(f"words_{n} int, share_{n} double" for n in LENGTHS) + ", line_share double"


def shares(documents: DataFrame) -> DataFrame:
    """Every document with its measures; null and empty texts have no words and all shares 0. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices([t or "" for t in texts]):
                columns = measures(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *[pa.array(x, f.type) for x, (_, f) in zip(columns, ((n, _KIND.field(n)) for n, _ in _FIELDS))]], schema=_KIND)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SQL)


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents of whose words 30 % or more lie in six words that occurred before."""
    return shares(documents).filter(F.col(f"words_{FOUND_LENGTH}") * 10 >= F.col("n_words") * FOUND_TENTHS).filter("n_words > 0").select("doc_id")
