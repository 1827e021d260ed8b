"""String similarity by longest matching blocks, which has no built-in counterpart: Arrow functions over the standard library.

The measure isn't symmetric, so the order of arguments is part of the meaning. Null in, null out.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import text as X


@lru_cache(200_000)
def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _token_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """``a`` and ``b``: the words of two titles."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        x, y = list(x), list(y)
        if not x or not y:
            out.append(0.0)
            continue
        common = sum((Counter(x) & Counter(y)).values())
        low, high = sorted((len(x), len(y)))
        inside = 0.9 + 0.1 * low / high if common == low and low >= 2 else 0.88 * common / low
        out.append(max(ratio("".join(x), "".join(y)), 2 * common / (low + high), inside))
    return pd.Series(out, dtype="float64")


def title_score(a: Column, b: Column) -> Column:
    """The best of letters in common, words in common, and one title inside the other."""
    return _token_score(X.title_tokens(a), X.title_tokens(b))


def dice(a: Column, b: Column) -> Column:
    """Words in common, as often as both have them, against all words; native, on arrays of words."""
    both = F.array_distinct(F.array_intersect(a, b))
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    common = F.aggregate(F.transform(both, lambda w: F.least(times(a, w), times(b, w))), F.lit(0), lambda s, n: s + n)
    return F.when(F.size(a) + F.size(b) > 0, 2 * common / (F.size(a) + F.size(b))).otherwise(0.0)


def similar_title(a: Column, b: Column, least: float = 0.86) -> Column:
    return similarity(X.title_key(a), X.title_key(b)) >= least


def consensus(vision: Column, second: Column, least: float = 0.97) -> Column:
    """Whether two readings agree: both plausible, the same marks in the same order, and nearly the same letters."""
    marks = lambda c: F.regexp_replace(c, r'[^.!?,;:"]', "")
    left, right = X.vote_key(vision), X.vote_key(second)
    return X.plausible(vision) & X.plausible(second) & (left != "") & (right != "") & (marks(vision) == marks(second)) & (similarity(left, right) >= least)
