"""Connected components by alternating large-star and small-star; every step is a minimum per node (combined on the map side) and one join back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Links (u, v) of long ids to (id, component_id) for every id that is linked; component_id is the smallest id reachable. Loops and repeated links are harmless."""
    now = materialize(_linked(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _linked(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        last, now = now, materialize(_linked(large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))), "links")
        discard(last)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(now.select("v", "v").distinct().toDF("id", "component_id"))
