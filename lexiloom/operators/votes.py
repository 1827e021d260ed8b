"""Choosing between readings of the same page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.functions.fuzzy import consensus, similarity
from lexiloom.functions.numeric import quadrant, reasons
from lexiloom.operators.ranking import running_sum

#: Fixed value: least agreement at which the second reading is taken although there is a first one.
AGREEMENT = 0.55


def two_way(pages: DataFrame, least: float = AGREEMENT) -> DataFrame:
    """``selected``, ``similarity`` (four digits) and ``used`` of pages with readings ``vision`` and ``unlimited``.

    The second reading is taken if it isn't empty and there is no first, or they agree. Null readings count as empty.
    """
    v, u = X.normalize_line(F.coalesce("vision", F.lit(""))), F.coalesce("unlimited", F.lit(""))
    p = pages.withColumns({"_v": v, "_u": u})
    p = p.withColumn("_r", F.when(F.col("_u") == "", 0.0).otherwise(similarity(X.title_key(F.col("_v")), X.title_key(F.col("_u")))))
    second = (F.col("_u") != "") & ((F.col("_v") == "") | (F.col("_r") >= least))
    p = p.withColumn("selected", F.when(second, F.col("_u")).otherwise(F.col("_v")))
    used = F.when((F.col("selected") == F.col("_u")) & (F.col("_u") != ""), "unlimited_ocr").otherwise("vision_fallback")
    return p.withColumns({"similarity": F.round("_r", 4), "used": used}).drop("_v", "_u", "_r")


def three_way(pages: DataFrame) -> DataFrame:
    """As :func:`two_way` with a third reading ``candidate`` where there is one; adds ``chosen``, ``by`` and ``reasons``.

    ``pages``: ``title, page, vision, unlimited, used, candidate``. Agreeing readings win, then a plausible third, then the base.
    """
    title = F.coalesce("title", F.lit(""))
    raw_v, raw_u, third = F.coalesce("vision", F.lit("")), F.coalesce("unlimited", F.lit("")), F.coalesce("candidate", F.lit(""))
    p = pages.withColumns({"_v": X.clean_transcription(raw_v, title), "_u": X.clean_transcription(raw_u, title), "_c": third})
    p = p.withColumns({"_base": F.when(F.col("used") == "unlimited_ocr", F.col("_u")).otherwise(F.col("_v")), "_same": consensus(F.col("_v"), F.col("_u"))})
    good = X.plausible(F.col("_c"))
    chosen = F.when(F.col("_same"), F.col("_base")).when(good, F.col("_c")).otherwise(F.col("_base"))
    p = p.withColumn("chosen", chosen)
    by = F.when(F.col("_same"), "vision_unlimited_consensus").when((F.col("_c") != "") & (F.col("chosen") == F.col("_c")), "third").otherwise(F.col("used"))
    page = F.col("page").cast("string")
    why = reasons(
        (X.is_disputed(title, raw_v, raw_u, F.col("used")) & (F.col("_c") == ""), F.concat(F.lit("third_ocr_pending_page:"), page)),
        ((F.col("_c") != "") & ~good, F.concat(F.lit("third_rejected_page:"), page)),
    )
    return p.withColumns({"by": by, "reasons": why}).drop("_v", "_u", "_c", "_base", "_same")


def lesson_pieces(pages: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """The texts of a lesson's pages as one line each, with ``begin``: where it stands in the lesson's whole text, in which
    pages are parted by a blank. Empty pages are left out. The whole text stays in pieces, as it may be of any length."""
    p = pages.withColumn("piece", X.normalize_line(F.coalesce(text, F.lit("")), compose=False)).filter("piece != ''").withColumn("_n", F.length("piece") + 1)
    return running_sum(p, [key], order, "_n", "_end").withColumn("begin", F.col("_end") - F.col("_n")).drop("_n", "_end")


def sheet_texts(sheets: DataFrame, raw: str = "raw") -> DataFrame:
    """Page texts of contact sheets of four: blocks to quadrants, usable text blocks from top to bottom, joined.

    Adds ``quadrant`` (0 to 3) and ``text``; quadrants without text give no row.
    """
    keys = [c for c in sheets.columns if c != raw]
    b = sheets.select(*keys, F.posexplode(X.parse_blocks(F.col(raw))).alias("i", "b"))
    b = b.withColumn("quadrant", quadrant(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1"))).filter((F.col("b.type") == "text") & X.usable_text(F.col("b.text")))
    parts = F.array_sort(F.collect_list(F.struct("b.y0", "b.x0", "i", "b.text")))
    return b.groupBy(*keys, "quadrant").agg(X.normalize_line(F.array_join(F.transform(parts, lambda x: x["text"]), " "), compose=False).alias("text"))
