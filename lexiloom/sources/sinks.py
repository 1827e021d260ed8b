"""Writing results: by level, in two parts, all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.quality import split_by_gate
from lexiloom.session import cut
from lexiloom.sources.readers import exists


def packages(library: DataFrame, path: str) -> None:
    """A folder per level and one of the passed lessons, as JSON lines."""
    library.repartition("level", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("level").json(f"{path}/levels")
    library.filter("status = 'pass'").write.mode("overwrite").json(f"{path}/passed")


def published(df: DataFrame, path: str) -> None:
    """Write beside ``path``, then take its place: readers never see some rows of both. Between the two renames there is nothing at
    ``path`` for a moment, in which a reader fails; the old rows are kept until the new ones are in place."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staging, old = f"{path}.staging", f"{path}.old"
    df.write.mode("overwrite").parquet(staging)
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    p = jvm.org.apache.hadoop.fs.Path
    fs.delete(p(old), True)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(staging), p(path))
    fs.delete(p(old), True)


def quarantined(df: DataFrame, path: str, gate: str = "passed") -> None:
    """Accepted rows to ``accepted``, the others to ``rejected``."""
    good, bad = split_by_gate(cut(df), gate)
    good.write.mode("overwrite").parquet(f"{path}/accepted")
    bad.write.mode("overwrite").parquet(f"{path}/rejected")


def appended(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def ensured(spark: SparkSession, name: str, columns: str, path: str) -> None:
    """A table at ``path``, made unless it is there; a second call changes nothing."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{path}'")


def appended_lines(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows as JSON lines, but for those whose keys are in the file already; returns what was added."""
    spark = df.sparkSession
    new = df
    if exists(spark, path):
        new = df.join(spark.read.schema(df.schema).json(path).select(*keys).distinct(), keys, "left_anti")
    new = cut(new)
    new.write.mode("append").json(path)
    return new


def labels(df: DataFrame, path: str, text: str = "text", by: str = "speaker") -> None:
    """Texts as plain files, a folder per ``by``."""
    df.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def sorted_map(df: DataFrame, path: str, key: str) -> None:
    """Rows in order of a key over all files."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").json(path)
