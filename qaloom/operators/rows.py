"""Row-level operators: latest delivery of a record and ranks inside hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.plans.staging import staged


def latest_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per `key`: the one with the greatest `order`, nulls first.

    Ties in `order` are broken by the other columns, so the result doesn't depend on the input's order. Rows without a
    key are left out; an empty table gives an empty table.
    """
    rest = [c for c in columns if c != key]
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(order).alias("_order"), *rest)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_once(df: DataFrame, key: str, order: str, columns: list[str], broadcast_rows: int = 500_000) -> DataFrame:
    """`latest_rows` for wide rows of which few keys repeat: only rows of repeated keys are shuffled.

    Keys are counted by themselves first. If up to `broadcast_rows` repeat they are broadcast, so all other rows stay where
    they are read; if more do, all rows are shuffled as in `latest_rows`. The result is the same.
    """
    repeated = staged(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key))
    if repeated.count() > broadcast_rows:
        return latest_rows(df, key, order, columns)
    few = F.broadcast(repeated)
    once = df.where(F.col(key).isNotNull()).join(few, key, "left_anti")
    rest = [c for c in columns if c != key]
    return once.select(key, *rest).unionByName(latest_rows(df.join(few, key, "left_semi"), key, order, columns))


def rank_within(df: DataFrame, key: str, order: list[Column], spread: Column, rank: str, buckets: int = 64) -> DataFrame:
    """A rank from 0 inside each `key`, ordered by the bucket of `spread` and then by `order`.

    Exact at any skew: a hot key is cut into `buckets` by hash, ranks are counted inside a bucket, and the counts of the
    earlier buckets are added. No task sees more than a bucket of a key.
    """
    cut = df.withColumn("_rank_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    counts = cut.groupBy(F.col(key).alias("_rank_key"), F.col("_rank_bucket").alias("_rank_b")).agg(F.count(F.lit(1)).alias("_rank_n"))
    before = counts.withColumn("_rank_before", F.sum("_rank_n").over(Window.partitionBy("_rank_key").orderBy("_rank_b")) - F.col("_rank_n"))
    inside = cut.withColumn("_rank_inside", F.row_number().over(Window.partitionBy(key, "_rank_bucket").orderBy(*order)) - 1)
    joined = inside.join(before, (F.col(key).eqNullSafe(F.col("_rank_key"))) & (F.col("_rank_bucket") == F.col("_rank_b")))
    return joined.withColumn(rank, F.col("_rank_before") + F.col("_rank_inside")).drop("_rank_bucket", "_rank_key", "_rank_b", "_rank_n", "_rank_before", "_rank_inside")


def positions(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """`df` with the 0-based position of each row by `order`, a unique column; no task sees more than a range of rows.

    Rows are sorted in ranges; numbers inside a range are added to the sizes of the ranges before it.
    """
    inside = df.orderBy(order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    inside = inside.withColumn("_in", F.col("_id") - F.shiftleft(F.col("_part").cast("bigint"), 33))
    inside = staged(inside.drop("_id"))  # the ranges of a sort are drawn by sampling: once, not per read
    sizes = inside.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a range
    return inside.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_p", "_before")
