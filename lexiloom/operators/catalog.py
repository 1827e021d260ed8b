"""Matching lessons with recordings by title: candidates, margins, one recording for each lesson at most."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.functions.fuzzy import dice
from lexiloom.operators.ranking import top_per_group
from lexiloom.session import cut, join_small

#: Least score, least margin, score that needs no margin.
SCORE, MARGIN, EXACT = 0.84, 0.035, 0.9999
#: Titles of a level that are compared in one piece, about so many on each side.
PIECE = 512


def title_pairs(left: DataFrame, right: DataFrame, block: str = "level", least: float = 0.8) -> DataFrame:
    """``block, left_id, right_id, score`` of titles of one block whose words agree by at least ``least`` (Dice).

    Both sides: ``id, block, title``, unique by id. Not all pairs of a block are formed: words are ordered by rarity, and two
    titles can agree by ``least`` only if they share one of their rarest words, as many as the bound leaves room for.
    By letters or containment titles can agree without that; for those see :func:`best_pairs`.
    """
    sides = []
    for name, df in (("left", left), ("right", right)):
        sides.append(cut(df.select(F.col(block).alias("block"), F.col("id").alias(f"{name}_id"), X.title_tokens(F.col("title")).alias(name)).filter(F.size(name) > 0)))
    tokens = sides[0].select("block", F.explode(F.array_distinct("left")).alias("t")).unionByName(sides[1].select("block", F.explode(F.array_distinct("right")).alias("t")))
    rare = tokens.groupBy("block", "t").agg(F.count(F.lit(1)).alias("df"))

    def prefixed(df: DataFrame, name: str) -> DataFrame:
        each = df.select("block", f"{name}_id", F.size(name).alias("n"), F.explode(F.array_distinct(name)).alias("t")).join(rare, ["block", "t"])
        ranked = each.groupBy("block", f"{name}_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))  # one title's words
        share = least / (2 - least)
        keep = F.greatest(F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1, F.lit(1)).cast("int")
        return ranked.select("block", f"{name}_id", F.explode(F.slice("ts", 1, keep)).alias("x")).select("block", f"{name}_id", "x.t")

    pairs = prefixed(sides[0], "left").join(prefixed(sides[1], "right"), ["block", "t"]).select("block", "left_id", "right_id").distinct()
    j = pairs.join(sides[0], ["block", "left_id"]).join(sides[1], ["block", "right_id"])
    words = dice(F.col("left"), F.col("right"))
    return j.filter(words >= least - 1e-9).select("block", "left_id", "right_id", words.alias("score"))


def _common(xs: list[list[str]], ys: list[list[str]]) -> np.ndarray:
    """How many words (or letters) each of ``xs`` has in common with each of ``ys``, as often as both have them."""
    ids: dict[tuple[str, int], int] = {}
    flat = []
    for side in (xs, ys):
        flat.append([])
        for i, words in enumerate(side):
            n: Counter = Counter()
            for w in words:
                flat[-1].append((i, ids.setdefault((w, n[w]), len(ids))))
                n[w] += 1
    both = []
    for side, places in zip((xs, ys), flat):
        m = np.zeros((len(side), len(ids)), np.float32)
        m[tuple(np.array(places).T)] = 1
        both.append(m)
    return both[0] @ both[1].T


def _in_order(xs: list[str], ys: list[str]) -> np.ndarray:
    """At least as many letters as each of ``xs`` has in the same order as each of ``ys``, which no matching blocks exceed.

    The longest common subsequence, one bit for each letter of ``ys``; for those of more than 64 letters, letters in any order.
    """
    letters = {c: k for k, c in enumerate(sorted(set("".join(xs)) | set("".join(ys))), 1)}
    bits = np.zeros((len(letters) + 1, len(ys)), np.uint64)
    for j, y in enumerate(ys):
        for k, c in enumerate(y[:64]):
            bits[letters[c], j] |= np.uint64(1 << k)
    at = np.zeros((len(xs), max(map(len, xs))), np.int64)  # letter 0 is none
    for i, x in enumerate(xs):
        at[i, : len(x)] = [letters[c] for c in x]
    v = np.full((len(xs), len(ys)), ~np.uint64(0))
    for k in range(at.shape[1]):
        u = v & bits[at[:, k]]
        v = (v + u) | (v - u)
    ends = np.array([(1 << min(len(y), 64)) - 1 for y in ys], np.uint64)
    n = np.bitwise_count(~v & ends).astype(np.float64)
    long = [j for j, y in enumerate(ys) if len(y) > 64]
    if long:
        n[:, long] = _common([list(x) for x in xs], [list(ys[j]) for j in long])
    return n


def _best(left: list[tuple[str, list[str]]], right: list[tuple[str, list[str]]], least: float) -> list[tuple[str, str, float]]:
    """The two best of the right side for each of the left side, and the other way round, of those that reach ``least``.

    The score is that of :func:`lexiloom.functions.fuzzy.title_score`. Letters are compared only where an upper bound of their
    score leaves a pair a chance to be among the two best of either title.
    """
    left, right = sorted(left), sorted(right)  # of equal scores, the smaller id is first
    c = _common([w for _, w in left], [w for _, w in right]).astype(np.float64)
    m, n = np.array([[len(w)] for _, w in left]), np.array([[len(w) for _, w in right]])
    low, high = np.minimum(m, n), np.maximum(m, n)
    score = np.maximum(2 * c / (low + high), np.where((c == low) & (low >= 2), 0.9 + 0.1 * low / high, 0.88 * c / low))
    xs, ys = ["".join(w) for _, w in left], ["".join(w) for _, w in right]
    bound = 2 * _in_order(xs, ys) / (np.array([[len(x)] for x in xs]) + np.array([[len(y) for y in ys]]))
    least -= 1e-9

    def second(values: np.ndarray) -> float:
        return max(least, float(np.partition(values, -2)[-2])) if len(values) > 1 else least

    rows, columns = [second(r) for r in score], [second(r) for r in score.T]
    i, j = np.nonzero((bound > score) & (bound >= np.minimum(np.array(rows)[:, None], np.array(columns))))
    order = np.argsort(-bound[i, j], kind="stable")
    matchers: dict[int, SequenceMatcher] = {}
    for a, b, most in zip(i[order].tolist(), j[order].tolist(), bound[i, j][order].tolist()):
        if most < rows[a] and most < columns[b]:
            continue
        if (matcher := matchers.get(b)) is None:
            matcher = matchers[b] = SequenceMatcher(None, "", ys[b])
        matcher.set_seq1(xs[a])
        own = matcher.ratio()
        if own > score[a, b]:
            score[a, b] = own
            if own > rows[a]:
                rows[a] = second(score[a])
            if own > columns[b]:
                columns[b] = second(score[:, b])
    keep = set()
    for a, r in enumerate(score):
        keep.update((a, b) for b in np.argsort(-r, kind="stable")[:2].tolist() if r[b] >= least)
    for b, r in enumerate(score.T):
        keep.update((a, b) for a in np.argsort(-r, kind="stable")[:2].tolist() if r[a] >= least)
    return [(left[a][0], right[b][0], float(score[a, b])) for a, b in keep]


_PAIR_KIND = pa.schema([("block", pa.string()), ("left_id", pa.string()), ("right_id", pa.string()), ("score", pa.float64())])


def best_pairs(left: DataFrame, right: DataFrame, block: str = "level", least: float = 0.6, piece: int = PIECE) -> DataFrame:
    """``block, left_id, right_id, score`` by :func:`lexiloom.functions.fuzzy.title_score`: letters, words or containment.

    Both sides: ``id, block, title``, unique by id. Every pair of a block that reaches ``least`` by any of the three measures
    counts; those are kept that can be one of the two best of their left or right title, which is what :func:`margins` looks
    at. Both sides of a block are split into pieces of about ``piece`` titles, and each two pieces compared on their own.
    """
    sides, sizes = [], []
    for name, df in (("left", left), ("right", right)):
        side = cut(df.select(F.col(block).cast("string").alias("block"), F.col("id").cast("string").alias("id"), X.title_tokens(F.col("title")).alias("w")).filter("block is not null and id is not null and size(w) > 0"))
        n = side.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / piece).alias(f"{name}_n"))
        part = join_small(side, n, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col(f"{name}_n")).cast("int"))
        sides.append(part.groupBy("block", F.col("part").alias(f"{name}_part")).agg(F.collect_list(F.struct("id", "w")).alias(name)))  # about a piece
        sizes.append(n)
    tasks = sizes[0].join(sizes[1], "block").agg(F.sum(F.col("left_n") * F.col("right_n"))).first()[0] or 1
    pairs = sides[0].join(sides[1], "block").repartition(min(int(tasks), 2000), "block", "left_part", "right_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, xs, ys in zip(b.column("block").to_pylist(), b.column("left"), b.column("right")):
                found = _best([(t["id"], t["w"]) for t in xs.as_py()], [(t["id"], t["w"]) for t in ys.as_py()], least)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found)), *[pa.array(x) for x in zip(*found)]], schema=_PAIR_KIND)

    return cut(pairs.mapInArrow(run, "block string, left_id string, right_id string, score double"))


def margins(pairs: DataFrame, left_copies: DataFrame | None = None, right_copies: DataFrame | None = None) -> DataFrame:
    """For each left id its best right id by score (ties: the smaller id), with the margin.

    The margin is the smaller of two leads: of the best over the second recording of the lesson, and over the second lesson of
    the recording. A lesson that isn't the recording's best has a lead of zero or less there. Missing seconds count as 0.

    Where ``pairs`` are of representatives, ``left_copies`` and ``right_copies`` (``block, id, copy``) have all that each
    stands for, itself too: copies are each other's seconds, and every left copy has a row of its own.
    """

    def sized(copies: DataFrame | None, side: str, n: str) -> DataFrame:
        if copies is None:
            return pairs.select("block", side).distinct().withColumn(n, F.lit(1))
        return copies.groupBy("block", F.col("id").alias(side)).agg(F.count(F.lit(1)).alias(n))

    def two(side: str, other: str, n: DataFrame) -> DataFrame:
        top = top_per_group(pairs, ["block", side], [F.desc("score"), F.col(other)], 2).join(n, ["block", other])
        return top.groupBy("block", side).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(other).alias("o"), "n"))).alias("two"))

    first = F.col("two")[0]
    behind = F.when(first["n"] > 1, -first["s"]).otherwise(F.coalesce(-F.get("two", F.lit(1))["s"], F.lit(0.0)))
    best = two("left_id", "right_id", sized(right_copies, "right_id", "n")).select("block", "left_id", first["o"].alias("right_id"), (-first["s"]).alias("score"), behind.alias("second"))
    back = two("right_id", "left_id", sized(left_copies, "left_id", "n")).select("block", "right_id", behind.alias("second_lesson"))
    j = best.join(back, ["block", "right_id"])
    if left_copies is not None:
        j = j.join(left_copies.withColumnRenamed("id", "left_id"), ["block", "left_id"]).drop("left_id").withColumnRenamed("copy", "left_id")
    return j.select("block", "left_id", "right_id", "score", "second", "second_lesson", F.least(F.col("score") - F.col("second"), F.col("score") - F.col("second_lesson")).alias("margin"))


def assigned(best: DataFrame, overrides: DataFrame | None = None, score: float = SCORE, margin: float = MARGIN) -> DataFrame:
    """One recording for each lesson and one lesson for each recording, best first; ``outcome`` says how it went.

    In order of score and margin (ties: the smaller id) the first acceptable lesson takes a recording; whoever comes later finds
    it in use, even if not acceptable itself. ``overrides``: ``left_id, right_id``; a null right id switches a lesson off.
    """
    ok = (F.col("score") >= EXACT) | (F.col("score") >= score) & (F.col("margin") >= margin)
    rows = best.withColumn("ok", ok)
    if overrides is not None:
        given = overrides.select("left_id", F.col("right_id").alias("_forced"), F.lit(True).alias("_given"))
        rows = rows.join(given, "left_id", "left")
        used = overrides.filter("right_id is not null").select("right_id").distinct().withColumn("_used", F.lit(True))
        rows = rows.join(used, "right_id", "left")
    else:
        rows = rows.withColumns({"_forced": F.lit(None).cast("string"), "_given": F.lit(None).cast("boolean"), "_used": F.lit(None).cast("boolean")})
    # who is first among the acceptable lessons of a recording: an aggregate, then a join, as no window is needed
    rank = F.struct((-F.col("score")).alias("a"), (-F.col("margin")).alias("b"), F.col("left_id").alias("c"))
    rows = cut(rows.withColumn("_rank", rank))
    first = rows.filter("ok and _given is null").groupBy("right_id").agg(F.min("_rank").alias("_first"))
    j = rows.join(first, "right_id", "left")
    taken = F.coalesce(F.col("_used"), F.lit(False)) | F.coalesce(F.col("_first") < F.col("_rank"), F.lit(False))
    outcome = F.when(F.col("_given") & F.col("_forced").isNull(), "disabled").when(F.col("_given"), "override").when(taken, "audio-already-used").when(~F.col("ok"), "ambiguous-or-low-score").otherwise("mapped")
    return j.select("block", "left_id", F.when(F.col("_given"), F.col("_forced")).otherwise(F.col("right_id")).alias("right_id"), F.when(F.col("_given"), 1.0).otherwise(F.col("score")).alias("score"), "margin", outcome.alias("outcome"))


def level_summary(**sources: DataFrame) -> DataFrame:
    """One row per level that any source has, with the count of each source; each source has a column ``level``."""
    out = None
    for name, df in sources.items():
        counts = df.groupBy("level").agg(F.count(F.lit(1)).alias(name))
        out = counts if out is None else out.join(counts, "level", "full")
    return out.na.fill(0)
