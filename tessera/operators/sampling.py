"""Seeded order, stratified sampling and the train/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(seed: int, column: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def stratified(rows: DataFrame, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each stratum in seeded order, strata that differ by case only being one; Spark cuts each partition to its n before it shuffles. `shuffled` orders them all."""
    w = Window.partitionBy(F.lower(stratum)).orderBy(order(seed), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def shuffled(rows: DataFrame, seed: int = 42) -> DataFrame:
    """O2: all rows in seeded order, by range partitions."""
    return rows.orderBy(order(seed), "id")


def numbered(rows: DataFrame, seed: int = 42, parts: int = 256) -> DataFrame:
    """`number` from 1 in seeded order. Rows are dealt into ranges of the order's digest; a range is numbered by itself, after the counts of those before it (one row for each range)."""
    key = rows.withColumn("order", order(seed)).withColumn("range", F.conv(F.substring("order", 1, 4), 16, 10).cast("int") % 65536)
    key = key.withColumn("range", F.floor(F.col("range") * parts / 65536).cast("int"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = key.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("order", "id"))
    return key.join(F.broadcast(starts), "range").withColumn("number", F.col("start") + own).drop("order", "range", "start")


def split(rows: DataFrame, label: str | None = None, seed: int = 42) -> DataFrame:
    """Of all n rows that have a label, the first min(n-1, max(1, floor(n/5))) in seeded order are test, none where n is one; rows without a label have a null `test`."""
    if label:
        has = F.col(label).isNotNull() & (F.col(label).cast("string") != "")
        labelled, rest = rows.where(has), rows.where(~has)
    else:
        labelled, rest = rows, None
    n = F.count(F.lit(1))
    held = labelled.agg(F.when(n <= 1, 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.floor(n / 5)))).alias("held"))
    out = numbered(labelled, seed).crossJoin(F.broadcast(held)).withColumn("test", F.col("number") <= F.col("held")).drop("number", "held")
    return out if rest is None else out.unionByName(rest.withColumn("test", F.lit(None).cast("boolean")))
