"""Texts that were cut off (problem 4).

What an ending looks like is learnt from the whole corpus: for every word, how often a sentence ends with it and how often
it goes on. A text without a final mark whose last word is unknown, or hardly ever ends a sentence, has an incomplete
ending. A field limit shows as a jump in the discrete hazard of incomplete endings: of the texts of a source that reach a
length, the share that ends there incomplete. Each hazard is tested against those of the neighbouring lengths, with the
false discovery rate under control. At a significant length every ending without a mark is a cut by the limit (``how`` is
``limit``). A text cut in transfer has no length of its own; it shows by an incomplete ending at a length at which its source
doesn't cut (``how`` is ``transfer``), with an error rate of its own: how often, by the corpus, such last words do end a sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm.boundaries import BEFORE_NAME, BEFORE_NUMBER
from lexiloom.operators.ranking import numbered
from lexiloom.session import cut, join_small

#: Neighbours on either side that a hazard is tested against, and the false discovery rate.
NEIGHBOURS, RATE = 8, 0.001
#: A word that ends at most this share of its sentences doesn't end a text.
FINAL_SHARE = 0.01
#: Sources that must share a heading whose last word is otherwise unknown.
HEADING_SOURCES = 3

_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_STOP = r"\s.,!?;:…。！？，、：；،؟।॥“”\"()（）「」『』\[\]—"
_TOKEN = re.compile(rf"[^{_STOP}]+(?:\.[^{_STOP}]+)*")
_CLOSERS = "”’\"»」』）)]"
_CLOSED = "[" + re.escape(_CLOSERS) + "]*"
_FINAL = re.compile(rf"([^{_STOP}]+(?:\.[^{_STOP}]+)*){_CLOSED}(?:[.!?؟।॥]+{_CLOSED}(?:\s*\Z|\s+(?=[^\W\d_a-zà-öø-ÿ]|[“\"(¿¡]))|[。！？])")
_HAN = re.compile("[぀-ヿ㐀-鿿]")
_HAN_FINAL = re.compile("([぀-ヿ㐀-鿿]{1,2})[」』”）]*[。！？]")
_THAI = re.compile("[฀-๿]")
_DIGITS = re.compile(r"\d+")
_SMALL = {"a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "from", "at", "by"}
_ABBREVIATED = (BEFORE_NAME | BEFORE_NUMBER) - {"in", "min", "art", "sec", "mar", "no", "gen", "col", "rep", "sen", "hon", "vs"} | {"vs", "gen"}


def _key(token: str) -> str:
    return _DIGITS.sub("0", token.lower())


def _han(text: str) -> str:
    return "\0" + text[-2:] if len(text) > 1 and _HAN.match(text[-2]) else "\0" + text[-1:]


def _last(text: str) -> str:
    """The last word of a text of any length, or nothing."""
    size = 64
    while True:
        found = [m for m in _TOKEN.finditer(text[-size:])]
        if size >= len(text) or found and found[-1].start() > 1:
            return found[-1].group() if found else ""
        size *= 8


def statistics(texts: list[str]) -> dict[str, tuple[int, int]]:
    """For each word, how often it ends a sentence and how often it goes on. Ends without a mark count for neither."""
    every: Counter = Counter()
    final: Counter = Counter()
    for text in texts:
        if not text.isascii():
            text = _UNSEEN.sub("", text)
        every.update(map(_key, _TOKEN.findall(text)))
        ends = [_key(x) for x in _FINAL.findall(text)]
        final.update(ends)
        tail = text.rstrip().rstrip(_CLOSERS)
        if tail and tail[-1] not in ".!?。！？؟।":  # the open end
            last = _last(tail)
            if last:
                every[_key(last)] -= 1
        if not text.isascii():
            final.update("\0" + x for x in _HAN_FINAL.findall(text))
    return {k: (final[k], every[k] - final[k]) for k in {**every, **final}}


def ending(text: str) -> tuple[str, str | None, bool, bool]:
    """``kind, key, broken, heading``.

    Kinds: ``blank`` (nothing to judge), ``dash``, ``mark`` (a final mark), ``dots`` (trailing dots), ``open``. ``key`` is what the
    corpus is asked about, None where no question is left. ``broken``: incomplete whatever the corpus says.
    """
    seen = text if text.isascii() else _UNSEEN.sub("", text)
    body = seen.rstrip()
    inner = body.rstrip(_CLOSERS)
    if not inner:
        return "blank", None, False, False
    quotes = body.count("“") > body.count("”") or body.count("「") > body.count("」") or body.count('"') % 2 == 1 or body.count("(") > body.count(")")
    if inner[-1] == "—":
        return "dash", None, False, False
    if inner.endswith(("…", "...")):
        stem = inner.rstrip(".…")
        last = _last(stem)
        cut_mark = inner[-1] == "…" and not _HAN.search(stem[-1:])
        return "dots", _key(last) if last and cut_mark and not stem[-1:].isspace() else None, quotes or cut_mark and stem[-1:].isspace(), False
    if inner[-1] in ".!?。！？؟।॥":
        last = _last(inner.rstrip("."))
        low = last.lower()
        short = inner[-1] == "." and body == inner and (low in _ABBREVIATED or len(last) == 1 and last.isalpha() and last.isupper() or low in ("p", "e", "i"))
        return "mark", _key(last) if inner[-1] == "." and body == inner and last[:1].isdigit() else None, quotes or short, False
    if inner[-1] in ",;，；、" and body == inner:
        return "open", None, True, False
    words = _TOKEN.findall(inner)
    if not words:
        return "open", None, True, False
    capital = [w[:1].isupper() or w[:1].isdigit() or w in _SMALL for w in words]
    heading = len(words) > 1 and all(capital) and words[-1] not in _SMALL and "." not in inner
    if _HAN.match(inner[-1]):
        return "open", _han(inner), quotes or seen != body, False
    if _THAI.search(words[-1]) is None and words[-1].isdigit() and heading:
        return "open", None, False, True
    return "open", _key(words[-1]), quotes or seen != body or bool(words[-1].isdigit() and _THAI.search(inner)), heading


#: Words of which a task counts at a time.
HELD = 200_000
_SCAN = "row_id bigint, source_name string, chars int, bytes int, kind string, key string, broken boolean, heading string, ends bigint, goes_on bigint"
_KIND = pa.schema([("row_id", pa.int64()), ("source_name", pa.string()), ("chars", pa.int32()), ("bytes", pa.int32()), ("kind", pa.string()), ("key", pa.string()), ("broken", pa.bool_()), ("heading", pa.string()), ("ends", pa.int64()), ("goes_on", pa.int64())])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: their endings, and (with a null ``row_id``) what this task has counted of each word."""
    held: dict[str, list[int]] = {}

    def counted() -> pa.RecordBatch:
        n = len(held)
        columns = {"key": list(held), "ends": [v[0] for v in held.values()], "goes_on": [v[1] for v in held.values()]}
        out = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _KIND], schema=_KIND)
        held.clear()
        return out

    for b in batches:
        texts = b.column("text").to_pylist()
        rows = [ending(t) for t in texts]
        chars = [len(t) for t in texts]
        sizes = [n if t.isascii() else len(t.encode()) for t, n in zip(texts, chars)]
        yield pa.RecordBatch.from_arrays(
            [b.column("row_id"), b.column("source_name"), pa.array(chars, pa.int32()), pa.array(sizes, pa.int32()), *[pa.array([r[i] for r in rows], _KIND[4 + i].type) for i in range(3)], pa.array([t.strip() if r[3] else None for r, t in zip(rows, texts)], pa.string()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())],
            schema=_KIND,
        )
        for key, (ends, goes_on) in statistics(texts).items():
            at = held.setdefault(key, [0, 0])
            at[0] += ends
            at[1] += goes_on
        if len(held) > HELD:
            yield counted()
    yield counted()


def judged(df: DataFrame) -> DataFrame:
    """``row_id, source_name, chars, bytes, kind, incomplete, share`` of every text that isn't null.

    ``share``: how often the last word, where the corpus was asked about it, ends its sentences. One pass over the texts.
    """
    given = df.select(F.col("row_id").cast("bigint").alias("row_id"), "source_name", F.col("english").alias("text")).filter("text is not null")
    scanned = cut(given.mapInArrow(_scanned, _SCAN))
    rows = scanned.filter("chars is not null").drop("ends", "goes_on")
    known = scanned.filter("chars is null").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    asked = rows.select("key").filter("key is not null").distinct().join(known, "key", "left")
    ends, goes_on = F.coalesce(F.col("ends"), F.lit(0)), F.greatest(F.coalesce(F.col("goes_on"), F.lit(0)), F.lit(0))
    thai, unknown, share = F.col("key").rlike("[\\x{0E00}-\\x{0E7F}]"), ends + goes_on == 0, ends / F.greatest(ends + goes_on, F.lit(1))
    answers = cut(asked.select("key", unknown.alias("unknown"), F.when(thai | unknown, unknown).otherwise(share <= FINAL_SHARE).alias("never_ends"), share.alias("share")))
    j = rows.filter("key is null").withColumn("unknown", F.lit(False)).withColumn("never_ends", F.lit(False)).withColumn("share", F.lit(0.0)).unionByName(join_small(rows.filter("key is not null"), answers, "key", "left"))
    shared = rows.filter("heading is not null").groupBy("heading").agg(F.count_distinct("source_name").alias("n")).filter(F.col("n") >= HEADING_SOURCES).select("heading", F.lit(True).alias("shared"))
    titled = join_small(j.filter("heading is not null and unknown"), shared, "heading", "left")
    j = j.filter("heading is null or not unknown").withColumn("shared", F.lit(False)).unionByName(titled)
    incomplete = F.col("broken") | (F.col("never_ends") & ~F.coalesce("shared", F.lit(False)))
    return j.select("row_id", "source_name", "chars", "bytes", "kind", F.coalesce(incomplete, F.lit(False)).alias("incomplete"), "share")


def lengths(rows: DataFrame) -> DataFrame:
    """``source_name, unit, length, n, n_open, n_incomplete, at_risk``: how many texts of a source reach each length and end there.

    ``rows`` is the result of :func:`judged`. A window over the lengths of a source, not over its rows.
    """
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    n = (
        rows.select("source_name", units.alias("u"), "incomplete", F.col("kind").isin("open", "dots").alias("open")).select("source_name", "u.*", "incomplete", "open")
        .groupBy("source_name", "unit", "length")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"), F.count_if("incomplete").alias("n_incomplete"))
    )
    return n.withColumn("at_risk", F.sum("n").over(W.partitionBy("source_name", "unit").orderBy(F.desc("length"))))


def limits(rows: DataFrame) -> DataFrame:
    """``source_name, unit, length, at_risk, n_open, n_incomplete, hazard, expected``: the lengths at which a source cuts.

    ``rows`` is the result of :func:`judged`. The tail of the binomial is bounded by Chernoff's inequality; the false discovery rate
    is controlled by Benjamini and Hochberg's rule over all lengths of all sources.
    """
    n = lengths(rows)
    near = W.partitionBy("source_name", "unit").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    k, r = F.sum("n_incomplete").over(near) - F.col("n_incomplete"), F.sum("at_risk").over(near) - F.col("at_risk")
    n = n.withColumn("expected", (k + 0.5) / (r + 1.0)).withColumn("hazard", F.col("n_incomplete") / F.col("at_risk"))
    h, e = F.col("hazard"), F.col("expected")
    gain = h * F.ln(h / e) + F.when(h < 1, (1 - h) * F.ln((1 - h) / (1 - e))).otherwise(0.0)
    n = cut(n.withColumn("log_p", F.when(h > e, F.col("at_risk") * gain).otherwise(0.0)))
    tests = n.count()
    ranked = cut(numbered(n.filter("log_p > 0"), [], [F.desc("log_p"), F.col("source_name"), F.col("unit"), F.col("length")], "rank"))
    last = ranked.filter(F.col("log_p") >= F.ln(F.lit(float(max(1, tests))) / (F.lit(RATE) * F.col("rank")))).agg(F.max("rank")).first()[0]
    found = ranked.filter(F.col("rank") <= F.lit(last or 0))
    # a length at which texts stop for want of a mark alone isn't a limit
    found = found.filter("n_incomplete * 2 >= n_open and hazard >= 5 * expected")
    # most texts have as many bytes as characters; the unit that explains more endings is the source's own
    unit = found.groupBy("source_name", "unit").agg(F.sum("n_incomplete").alias("explained"))
    own = unit.groupBy("source_name").agg(F.max_by("unit", F.struct("explained", "unit")).alias("unit"))
    found = found.join(own.select(F.col("source_name").alias("own_source"), F.col("unit").alias("own_unit")), F.col("source_name").eqNullSafe(F.col("own_source")) & (F.col("unit") == F.col("own_unit")))
    return found.select("source_name", "unit", "length", "at_risk", "n_open", "n_incomplete", "hazard", "expected")


def cuts(df: DataFrame) -> DataFrame:
    """Every text that isn't null with ``how`` it was cut (``limit``, ``transfer`` or null) and ``is_cut``.

    ``limit``: without a mark, or incomplete, at a length at which its source cuts. A limit in bytes can't split a character, so
    texts up to two bytes below it count too if they aren't plain ASCII. ``transfer``: incomplete at any other length. Texts that end
    with a dash, and texts of nothing but blanks, are never cut. A null source is a source of its own.
    """
    rows = cut(judged(df))
    name = F.coalesce(F.concat(F.lit("="), F.col("source_name")), F.lit("null"))
    at = limits(rows).select(name.alias("source"), F.struct("unit", "length").alias("l")).groupBy("source").agg(F.collect_set("l").alias("limits"))  # few lengths per source
    j = join_small(rows.withColumn("source", name), at, "source", "left")
    wide = F.col("bytes") > F.col("chars")
    hit = F.exists(
        F.coalesce("limits", F.array().cast("array<struct<unit:string,length:int>>")),
        lambda x: ((x["unit"] == "chars") & (x["length"] == F.col("chars"))) | ((x["unit"] == "bytes") & ((x["length"] == F.col("bytes")) | wide & F.col("bytes").between(x["length"] - 2, x["length"]))),
    )
    how = F.when(hit & (F.col("kind").isin("open", "dots") | F.col("incomplete")), "limit").when(F.col("incomplete"), "transfer")
    return j.select("row_id", "source_name", "chars", "bytes", "kind", "incomplete", "share", how.alias("how")).withColumn("is_cut", F.col("how").isNotNull())


def found(df: DataFrame) -> DataFrame:
    """``row_id`` of the texts that were cut."""
    return cuts(df).filter("is_cut").select("row_id")


def by_source(df: DataFrame) -> DataFrame:
    """Per source: texts, cut texts (at a limit, in transfer) and their share; ``transfer_error``: the share of sentences that do
    end with such a last word, over the texts called cut in transfer."""
    transfer = F.col("how") == "transfer"
    g = cuts(df).groupBy("source_name").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("is_cut").alias("n_cut"), F.count_if(F.col("how") == "limit").alias("n_limit"), F.count_if(transfer).alias("n_transfer"), F.avg(F.when(transfer, F.col("share"))).alias("transfer_error")
    )
    return g.withColumn("cut_share", F.col("n_cut") / F.col("n_texts"))
