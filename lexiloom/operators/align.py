"""Words of a text against timed words: alignment, clip ranges, overlaps, diagnosis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.fuzzy import ratio
from lexiloom.operators.shards import pending, upserted

#: Fixed values of the alignment: substitution per missing similarity and at most, doubt, insertion, deletion, least match.
WEIGHT, UNLIKE, DOUBT, INSERT, DELETE, MATCH = 1.25, 1.15, 0.04, 0.82, 1.0, 0.5
#: Fixed values of the ranges: slack at an anchor, widest snap, least silence, default edges.
SLACK, SNAP, SILENCE, LEAD_IN, LEAD_OUT = 0.08, 0.45, 0.20, 0.18, 0.25


def align_words(expected: list[str], actual: list[str], probability: list[float]) -> dict[int, int]:
    """Semi-global alignment: position in ``expected`` -> position in ``actual``; actual words at either end cost nothing.

    Similarities are computed once per pair of distinct words, and each row of the table in one numpy sweep; of equal costs a
    match goes before an insertion, and that before a deletion.
    """
    n, m = len(expected), len(actual)
    if not n or not m:
        return {}
    own, xs = np.unique(np.array(expected, dtype=object), return_inverse=True)
    other, ys = np.unique(np.array(actual, dtype=object), return_inverse=True)
    like = np.array([[ratio(a, b) for b in other] for a in own])
    doubt = (1.0 - np.array(probability, dtype=float)) * DOUBT
    moves = np.zeros((n + 1, m + 1), dtype=np.uint8)  # 0 match, 1 insertion, 2 deletion
    moves[1:, 0] = 2
    above = np.zeros(m + 1)
    steps = np.arange(m + 1) * INSERT
    for i in range(1, n + 1):
        s = like[xs[i - 1]][ys]
        match = above[:-1] + np.where(s < MATCH, UNLIKE, (1.0 - s) * WEIGHT) + doubt
        drop = above[1:] + DELETE
        best = np.concatenate([[float(i)], np.minimum(match, drop)])
        row = np.minimum.accumulate(best - steps) + steps  # insertions carry the least cost to the right
        row = np.minimum(row, best)
        inserted = row[:-1] + INSERT
        moves[i, 1:] = np.where(match <= np.minimum(inserted, drop) + 1e-12, 0, np.where(inserted <= drop + 1e-12, 1, 2))
        above = row
    i, j, out = n, int(np.argmin(above)), {}
    while i > 0:
        move = moves[i, j]
        if move == 0 and j > 0:
            if like[xs[i - 1], ys[j - 1]] >= MATCH:
                out[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif move == 1 and j > 0:
            j -= 1
        else:
            i -= 1
    return out


_ANCHORS = "key string, pos int, matched int, expected int, first double, last double, probability double"


def anchors(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """For every sentence where its words were heard: ``key, pos, matched, expected, first, last, probability``.

    ``expected``: ``key, pos, words`` (one row per sentence); ``actual``: ``key, words, starts, ends, probabilities`` (one row per
    recording, arrays in order). A sentence of which nothing was heard has a null ``first``; so has a key without recording.
    """
    given = expected.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("sentences")).join(actual, "key", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                flat = [(k, w) for k, s in enumerate(r.sentences) for w in s["words"]]
                heard = list(r.words) if r.words is not None else []
                p = [1.0 if x is None or x != x else float(x) for x in r.probabilities] if heard else []
                found = align_words([w for _, w in flat], heard, p)
                for k, s in enumerate(r.sentences):
                    hits = [found[i] for i, (kk, _) in enumerate(flat) if kk == k and i in found]
                    rows.append((r.key, s["pos"], len(hits), len(s["words"]), r.starts[min(hits)] if hits else None, max(r.ends[h] for h in hits) if hits else None, sum(p[h] for h in hits) / len(hits) if hits else 0.0))
            yield pd.DataFrame(rows, columns=["key", "pos", "matched", "expected", "first", "last", "probability"])

    return given.mapInPandas(run, _ANCHORS)


def diagnosed(found: DataFrame) -> DataFrame:
    """Anchors with ``match_ratio`` and ``confidence``, four digits each."""
    share = F.col("matched") / F.greatest("expected", F.lit(1))
    return found.withColumns({"match_ratio": F.round(share, 4), "confidence": F.round(share * F.col("probability"), 4)})


def unanchored(found: DataFrame) -> DataFrame:
    """Per key: sentences, those without an anchor (their positions) and whether all were recovered."""
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("sentences"), F.sort_array(F.collect_list(F.when(F.col("first").isNull(), F.col("pos")))).alias("missing"), F.bool_and(F.col("first").isNotNull()).alias("recovered"))


#: Cells of time into which silences and anchors are sorted are at least this wide, in seconds.
CELL = 1.0


def _near(found: DataFrame, silences: DataFrame, first: Column, last: Column, reach: float) -> DataFrame:
    """``found`` with each silence of its key that may lie within ``reach`` of it, by cells of time: one recording with any
    number of anchors and silences is spread over its cells. ``silences``: ``key, s_start, s_end, mid``; only the middle counts.
    """
    width = F.lit(max(CELL, 2 * reach))
    cells = F.sequence(F.floor((first - reach) / width), F.floor((last + reach) / width))
    left = found.withColumn("_cell", F.explode(cells))
    return left.join(silences.withColumn("_cell", F.floor(F.col("mid") / width)), ["key", "_cell"], "left").drop("_cell")


def _long(silences: DataFrame, least: float) -> DataFrame:
    return silences.filter(F.col("s_end") - F.col("s_start") >= least).select("key", "s_start", "s_end", ((F.col("s_start") + F.col("s_end")) / 2).alias("mid"))


def snapped(found: DataFrame, silences: DataFrame, duration: Column | None = None, window: float = 2.0) -> DataFrame:
    """``key, pos, first, last, start, end``: each anchor widened to the middle of the silence next to it, or by a little.

    ``silences``: ``key, s_start, s_end``. Anchors meet silences by key and cell of time; of each anchor's silences only the nearest
    on either side are kept, by aggregation. The range reaches ``window``, but never beyond 0.45 s.
    """
    reach = min(window, SNAP)
    f = found.filter("first is not null")
    before = (F.col("s_end") <= F.col("first") + SLACK) & (F.col("first") - F.col("mid") <= reach)
    after = (F.col("s_start") >= F.col("last") - SLACK) & (F.col("mid") - F.col("last") <= reach)
    # the middle of a silence before an anchor lies within reach of its begin, or a little behind it
    ends = f.select("key", "pos", "first", "last", F.explode(F.array(F.col("first"), F.col("last"))).alias("_at"))
    j = _near(ends, _long(silences, SILENCE), F.col("_at"), F.col("_at"), reach + SLACK)
    top = duration if duration is not None else F.lit(float("inf"))
    g = j.groupBy("key", "pos", "first", "last").agg(F.max(F.when(before, F.col("mid"))).alias("a"), F.min(F.when(after, F.col("mid"))).alias("b"))
    return g.select("key", "pos", "first", "last", F.greatest(F.lit(0.0), F.coalesce("a", F.col("first") - LEAD_IN)).alias("start"), F.least(top, F.coalesce("b", F.col("last") + LEAD_OUT)).alias("end"))


def nearest(targets: DataFrame, silences: DataFrame, least: float = SILENCE, window: float = 2.0) -> DataFrame:
    """``key, pos, t, mid``: the middle of the nearest silence that is long and near enough; targets without one give no row."""
    j = _near(targets.select("key", "pos", "t"), _long(silences, least), F.col("t"), F.col("t"), window)
    away = F.abs(F.col("mid") - F.col("t"))
    return j.filter(away <= window).groupBy("key", "pos", "t").agg(F.min_by("mid", F.struct(away, F.col("mid"))).alias("mid"))


def without_overlaps(ranges: DataFrame) -> DataFrame:
    """Ranges of a key in order; two that overlap meet in the middle between their anchors. Rounded to milliseconds."""
    w = W.partitionBy("key").orderBy("pos")
    clash = F.coalesce(F.col("end") > F.lead("start").over(w), F.lit(False))
    meet = (F.col("last") + F.lead("first").over(w)) / 2
    r = ranges.withColumns({"_clash": clash, "_meet": meet})
    start = F.when(F.coalesce(F.lag("_clash").over(w), F.lit(False)), F.lag("_meet").over(w)).otherwise(F.col("start"))
    end = F.when(F.col("_clash"), F.col("_meet")).otherwise(F.col("end"))
    return r.select("key", "pos", "first", "last", F.round(start, 3).alias("start"), F.round(end, 3).alias("end"))


def word_offsets(sentences: DataFrame, key: str, pos: str, n: str) -> DataFrame:
    """``begin`` and ``finish`` of each sentence's words in its lesson."""
    w = W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    return sentences.withColumn("finish", F.sum(n).over(w)).withColumn("begin", F.col("finish") - F.col(n))


def shifted(windows: DataFrame, offset: Column) -> DataFrame:
    """Times within a window as times of the whole recording, and how far they moved from the rough ones."""
    out = windows.withColumns({"source_start": offset + F.col("start"), "source_end": offset + F.col("end")})
    return out.withColumns({"drift_start": F.col("source_start") - F.col("coarse_start"), "drift_end": F.col("source_end") - F.col("coarse_end")})


def refined(windows: DataFrame, risky: DataFrame, done: DataFrame, offset: str) -> DataFrame:
    """The table of refined windows after one more round: of the ``risky`` ids that aren't in ``done`` yet, the windows as times of
    the whole recording, marked ``fresh``, beside what was there; a window that comes again replaces the old one.

    ``windows``: ``id``, ``offset``, ``start, end, coarse_start, coarse_end``; ``done`` as the result: ``id, source_start, source_end,
    drift_start, drift_end, fresh``. A second round over the same input adds nothing.
    """
    todo = pending(windows.join(risky.select("id").distinct(), "id", "left_semi"), done, ["id"])
    new = shifted(todo, F.col(offset)).select("id", "source_start", "source_end", "drift_start", "drift_end", F.lit(True).alias("fresh"))
    return upserted(done, new, ["id"])
