"""Session defaults, table access and the few helpers every plan shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count proves it is within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexiloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; zone-less times become UTC timestamps, which watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not (sc.master or "").startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="lexiloom-")
            atexit.register(shutil.rmtree, at, True)
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, for tables that a query writes and reads again."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the session's shared checkpoint folder and read them from there.

    The folder is the session's own ``spark.checkpoint.dir``, see :func:`checkpoint_folder`.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven small: counts its rows and the length of its strings (never collects them)."""
    text = [c for c, t in df.dtypes if t == "string"]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(32))
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and b <= size


def join_small(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join ``big`` to ``small``, unique by ``key`` (a column or several), where one key may hold a third of ``big``.

    A proven-small side is broadcast. Otherwise both sides are salted, so that a hot key is spread over ``salts`` tasks.
    Null keys never match.
    """
    if fits_broadcast(small):
        return big.join(F.broadcast(small), key, how)
    keys = [key] if isinstance(key, str) else list(key)
    own = [c for c, t in big.dtypes if c not in keys and not t.startswith("map")]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*own) if own else F.lit(0), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
