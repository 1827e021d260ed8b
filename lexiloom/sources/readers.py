"""Reading the formats that lessons, pages and recordings come in. All schemas are given; none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.functions.numeric import duration_seconds
from lexiloom.operators.ranking import numbered
from lexiloom.operators.rejects import HEADER_NAMES

LESSON = "struct<id:string,level:string,title:string,titleZh:string,sentences:array<struct<id:string,english:string,chinese:string>>,sourceName:string>"
OCR_LINES = "path string, orientation string, score double, lines array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>, error string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of one kind; no rows where the path doesn't exist."""
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)


def lessons(spark: SparkSession, path: str) -> DataFrame:
    """Lessons of JSON files that are a list of lessons or an object with them in ``lessons``."""
    doc = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    as_list = F.from_json("value", f"array<{LESSON}>")
    as_object = F.from_json("value", f"struct<lessons:array<{LESSON}>>")["lessons"]
    each = doc.select("file", F.posexplode(F.when(F.ltrim("value").startswith("["), as_list).otherwise(as_object)).alias("pos", "l"))
    return each.select("file", "pos", "l.*").withColumnsRenamed({"titleZh": "title_zh", "sourceName": "source_name"})


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with quotes, doubled quotes and line feeds in fields, under the known names of their headers, and their ``file``.

    Columns whatever their order or language, which may differ from file to file; header names that aren't known are dropped, absent
    ones are null. Files with one header are read together.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("n"))
    first = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    out = None
    for header, names in first.groupBy("header").agg(F.collect_list("file")).collect():  # the names of the files, which the reader lists too
        raw = spark.read.csv(names, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False)
        known = {c: c.strip().lstrip("\ufeff").lower() for c in raw.columns}
        found = {target: next((c for c, n in known.items() if n in accepted), None) for target, accepted in HEADER_NAMES.items()}
        missing = [t for t in ("level", "lesson_id", "title", "english") if not found[t]]
        if missing:
            raise ValueError(f"columns missing in {names[0]}: {', '.join(missing)}")
        part = raw.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(t) for t, c in found.items()], F.col("_metadata.file_path").alias("file"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"{t} string" for t in [*HEADER_NAMES, "file"]))


def _complete(rows: DataFrame) -> DataFrame:
    """Rows that have every required value."""
    full = rows.withColumns({"level": F.trim("level"), "lesson_id": F.trim("lesson_id")})
    for c in ("level", "lesson_id", "title", "english"):
        full = full.filter(F.coalesce(F.col(c), F.lit("")) != "")
    return full


def csv_lessons(rows: DataFrame, row: str = "record_no") -> DataFrame:
    """Lessons with ``first_row``, by which they were met, and the number of their sentences.

    ``rows``: ``level, lesson_id, title, title_zh, sentence_id, english, chinese`` and a row number over the whole file. Rows
    without a required value are skipped.
    """
    g = _complete(rows).groupBy("level", "lesson_id")
    return g.agg(F.min(row).alias("first_row"), F.min_by("title", row).alias("title"), F.min_by(F.coalesce("title_zh", F.lit("")), row).alias("title_zh"), F.count(F.lit(1)).alias("n_sentences"))


def csv_sentences(rows: DataFrame, row: str = "record_no") -> DataFrame:
    """Their sentences with ``position`` in the lesson. A sentence without id gets ``lesson_id-row``.

    They stay rows, as one lesson may have any number of them.
    """
    sid = F.coalesce(F.nullif(F.col("sentence_id"), F.lit("")), F.concat_ws("-", "lesson_id", F.col(row)))
    n = numbered(_complete(rows), ["level", "lesson_id"], [row], "position")
    return n.select("level", "lesson_id", "position", sid.alias("id"), "english", F.coalesce("chinese", F.lit("")).alias("chinese"))


def ocr_cache(spark: SparkSession, path: str) -> DataFrame:
    """One row per page image from JSON lines; failed ones left out, the last of a path by its place in the file.

    With two orientations of an image the better score counts, upright on a draw.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    rows = raw.select("n", F.from_json("value", OCR_LINES).alias("r")).select("n", "r.*").filter("error is null and path is not null")
    last = rows.groupBy("path", "orientation").agg(F.max_by(F.struct("score", "lines"), "n").alias("r")).select("path", "orientation", "r.*")
    return last.groupBy("path").agg(F.max_by(F.struct("orientation", "score", "lines"), F.struct("score", F.when(F.col("orientation") == "up", 1).otherwise(0))).alias("r")).select("path", "r.*")


def listed(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame:
    """Lines of text files without blank ones and comments; with ``parts`` only ids whose second part is one of them."""
    rows = spark.read.text(path).select(F.trim("value").alias("id")).filter("id != '' and not startswith(id, '#')")
    return rows.filter(X.id_part(F.col("id"), 2).isin(parts)) if parts else rows


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``path, length, modified`` of all files under a folder with a suffix, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def silences(log: Column) -> Column:
    """``array<struct<s_start,s_end>>`` out of a silence detector's log; pairs that don't run forward are left out."""
    at = lambda what: F.transform(F.regexp_extract_all(log, F.lit(rf"silence_{what}:\s*(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return F.filter(F.arrays_zip(at("start").alias("s_start"), at("end").alias("s_end")), lambda x: x["s_end"] > x["s_start"])


def log_duration(log: Column) -> Column:
    return duration_seconds(F.regexp_extract(log, r"Duration:\s*(\d+:\d+:\d+(?:\.\d+)?)", 1))


def grid_bounds(grid: Column) -> Column:
    """``struct<first,last,words>`` of the words of an alignment grid; pauses don't count."""
    body = F.regexp_extract(grid, r'(?s)name\s*=\s*"words"(.*?)(?:name\s*=\s*"|\z)', 1)
    one = r'xmin\s*=\s*([\d.]+)\s*xmax\s*=\s*([\d.]+)\s*text\s*=\s*"([^"]*)"'
    get = lambda i: F.regexp_extract_all(body, F.lit(one), F.lit(i))
    spoken = F.filter(F.arrays_zip(get(1).alias("a"), get(2).alias("b"), get(3).alias("t")), lambda x: ~F.trim(x["t"]).isin("", "<eps>"))
    return F.struct(F.get(spoken, F.lit(0))["a"].cast("double").alias("first"), F.try_element_at(spoken, F.lit(-1))["b"].cast("double").alias("last"), F.size(spoken).alias("words"))


def timed_parts(tokens: DataFrame, least: float = 0.04) -> DataFrame:
    """Timed tokens of several words as one row per word, the time evenly split; shorter tokens than ``least`` are dropped.

    ``tokens``: ``key, seq, text, start, end, probability``.
    """
    t = tokens.filter(F.col("end") - F.col("start") > least).withColumn("parts", X.transcript_words(F.col("text"))).filter(F.size("parts") > 0)
    e = t.select("*", F.posexplode("parts").alias("part", "word"))
    step = (F.col("end") - F.col("start")) / F.size("parts")
    return e.select("key", "seq", "part", "word", (F.col("start") + step * F.col("part")).alias("start"), (F.col("start") + step * (F.col("part") + 1)).alias("end"), "probability")


def part_mismatches(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """``key, timed, words``: keys whose timed words are more or fewer than the words expected; none if all agree."""
    n = parts.groupBy("key").agg(F.count(F.lit(1)).alias("timed"))
    j = expected.select("key", F.col("words").cast("bigint").alias("words")).join(n, "key", "left").select("key", F.coalesce("timed", F.lit(0)).alias("timed"), "words")
    return j.filter(F.col("timed") != F.col("words"))
