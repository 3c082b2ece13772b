"""First-n-per-group that survives a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def behind(df: DataFrame, *before: Column, order: str = "ord") -> Column:
    """The order column behind other numbers, as an array: arrays compare place by place, so no number needs room within another."""
    own = F.col(order) if dict(df.dtypes)[order].startswith("array") else F.array(F.col(order).cast("bigint"))
    return F.concat(F.array(*[c.cast("bigint") for c in before]), own)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int | Column,
                  rank: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows of every group, in two exact rounds.

    Round one ranks inside (group, salt), so a group that holds a large share of all rows is cut
    down by many tasks; round two ranks what is left, at most ``n`` rows of a group and salt. There
    are as many salts as shuffle partitions. With a constant ``n`` the salt is the input partition
    and Spark also limits each group before the first shuffle (WindowGroupLimit). With a column there
    is no such limit: the salt is a hash of the order columns, and the explicit exchange keeps Spark
    from reusing an earlier partitioning by the group alone, which would undo the salt. A null ``n``
    keeps the whole group.
    """
    rn, salts = F.row_number(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limited = (lambda c: c <= n) if isinstance(n, int) else (lambda c: n.isNull() | (c <= n))
    if isinstance(n, int):
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    else:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts))).repartition(*keys, "_salt")
    part = (salted
            .withColumn("_rn", rn.over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
            .filter(limited(F.col("_rn"))).drop("_rn", "_salt"))
    name = rank or "_rn"
    out = (part.withColumn(name, rn.over(Window.partitionBy(*keys).orderBy(*order)))
           .filter(limited(F.col(name))))
    return out if rank else out.drop(name)


def capped(df: DataFrame, limit: int | DataFrame, scope: str, order: str) -> DataFrame:
    """First rows of each ``scope`` value, by one limit or by a (scope, limit) table.

    The table is joined here, behind the caller's aggregation: joined before it, the aggregate
    would inherit the join's partitioning by scope alone and a hot scope would stay in one task.
    """
    if isinstance(limit, int):
        return top_per_group(df, [scope], [order], limit)
    rows = df.join(limit.select(scope, F.col("limit").alias("_limit")), scope)
    return top_per_group(rows, [scope], [order], F.col("_limit")).drop("_limit")
