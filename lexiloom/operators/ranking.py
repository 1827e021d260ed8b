"""Row numbers and neighbours in groups of any size.

A window over one group runs in one task. Where a group may hold a large part of all rows, rows are sorted over all tasks by
group and order, numbered inside each task, and shifted by what lies in the tasks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.session import cut, fits_broadcast


def numbered(df: DataFrame, group: list[str], order: list[Column | str], name: str = "n", total: str | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in each group by ``order``, which must tell all rows of a group apart.

    ``total`` adds the size of the group. Null keys form a group of their own.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    placed = df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id())
    placed = cut(placed.withColumn("_i", F.row_number().over(W.partitionBy("_part", *group).orderBy(*[F.col(c) if isinstance(c, str) else c for c in order]))))
    parts = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = parts.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(W.partitionBy(*group)).alias("_total")
    )
    if fits_broadcast(shift):
        shift = F.broadcast(shift)
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = placed.join(shift, on).withColumn(name, (F.col("_i") + F.col("_shift")).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_i", "_p", "_shift", "_total", *[f"_g{i}" for i in range(len(group))])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; an aggregation, so that a hot key is reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def with_first_place(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, with ``first_place``: the least ``order`` at which the key was met."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.min(F.struct(*order)).alias("first_place")).select(*keys, "_row.*", "first_place")


def chunked(df: DataFrame, group: list[str], order: list[Column | str], size: int, name: str = "chunk") -> DataFrame:
    """Runs of ``size`` rows of each group, numbered from 0."""
    return numbered(df, group, order, "_row").withColumn(name, F.floor((F.col("_row") - 1) / size)).drop("_row")


def evenly_spaced(df: DataFrame, group: list[str], order: list[Column | str], count: int) -> DataFrame:
    """``count`` rows of each group at even distances, first and last among them; all rows of smaller groups."""
    n = numbered(df, group, order, "_row", "_size")
    if count < 2:
        return n.filter("_row = 1").drop("_row", "_size")
    at = F.bround((F.col("_k") * (F.col("_size") - 1)) / F.lit(count - 1), 0).cast("bigint") + 1
    # the place k that may fall on a row is next to the row's own share
    k = F.greatest(F.floor((F.col("_row") - 1) * F.lit(count - 1) / F.greatest(F.col("_size") - 1, F.lit(1))), F.lit(0))
    near = n.withColumn("_k", F.explode(F.array(k, k + 1)))
    hit = near.filter((F.col("_size") > count) & (F.col("_k") < count) & (at == F.col("_row"))).dropDuplicates([*group, "_row"])
    return n.filter(F.col("_size") <= count).drop("_row", "_size").unionByName(hit.drop("_row", "_size", "_k"))


def running_sum(df: DataFrame, group: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to and with each row of its group, for groups of any size."""
    columns = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    placed = df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id())
    w = W.partitionBy("_part", *group).orderBy(*[F.col(c) if isinstance(c, str) else c for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = cut(placed.withColumn("_s", F.sum(value).over(w)))
    parts = placed.groupBy("_part", *group).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = parts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    if fits_broadcast(shift):
        shift = F.broadcast(shift)
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(shift, on).withColumn(name, F.col("_s") + F.col("_shift")).drop("_part", "_s", "_p", "_shift", *[f"_g{i}" for i in range(len(group))])


def neighbours(df: DataFrame, group: list[str], order: list[Column | str], columns: list[str]) -> DataFrame:
    """``df`` with ``previous_x`` and ``next_x`` of each of ``columns``, for groups of any size.

    Rows are sorted over all tasks; inside a task neighbours come from a window, and only the first and last row of each group in each
    task look at the border rows of the tasks beside it.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*[F.col(g) for g in group], *keys).withColumn("_part", F.spark_partition_id())
    w = W.partitionBy("_part", *group).orderBy(*keys)
    values = F.struct(*columns)
    placed = cut(placed.withColumns({"_v": values, "_prev": F.lag(values).over(w), "_next": F.lead(values).over(w), "_i": F.row_number().over(w)}))
    edges = placed.groupBy("_part", *group).agg(F.min_by("_v", "_i").alias("_first"), F.max_by("_v", "_i").alias("_last"))
    beside = W.partitionBy(*group).orderBy("_part")
    border = edges.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.lag("_last").over(beside).alias("_before"), F.lead("_first").over(beside).alias("_behind"))
    if fits_broadcast(border):
        border = F.broadcast(border)
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = placed.join(border, on)
    before, behind = F.coalesce("_prev", "_before"), F.coalesce("_next", "_behind")
    out = out.withColumns({f"previous_{c}": before[c] for c in columns} | {f"next_{c}": behind[c] for c in columns})
    return out.drop("_part", "_v", "_prev", "_next", "_i", "_p", "_before", "_behind", *[f"_g{i}" for i in range(len(group))])


def last_seen(df: DataFrame, group: list[str], order: list[Column | str], column: str, name: str) -> DataFrame:
    """``df`` with ``name``: the last value of ``column`` that isn't null up to and with each row of its group, groups of any size."""
    columns = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    placed = df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id())
    w = W.partitionBy("_part", *group).orderBy(*[F.col(c) if isinstance(c, str) else c for c in order])
    own = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = cut(placed.withColumns({"_s": F.last(column, ignorenulls=True).over(own), "_i": F.row_number().over(w)}))
    parts = placed.groupBy("_part", *group).agg(F.max_by("_s", "_i").alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = parts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.last("_n", ignorenulls=True).over(before).alias("_shift"))
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(shift, on).withColumn(name, F.coalesce("_s", "_shift")).drop("_part", "_s", "_i", "_p", "_shift", *[f"_g{i}" for i in range(len(group))])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, salts: int = 16) -> DataFrame:
    """The first ``k`` rows of each group by ``order``. Rows are thinned out in parts of each group first, so a hot group is spread."""
    part = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(salts)))
    few = part.withColumn("_n", F.row_number().over(W.partitionBy(*group, "_salt").orderBy(*order))).filter(F.col("_n") <= k)
    return few.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= k).drop("_n", "_salt")
