"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source has a weight; the mix shares `share` times all words by weight, but no source is repeated more than `epochs` times. Sources over that bound are clamped and
their excess goes to the others by weight until none is above. With sources sorted by cap/weight the clamped ones are a prefix, so the water level is the largest of
(budget - caps before) / (weights from here on): a window over the sources, no loop.

A source's target is then floor(target / size) whole repetitions of each document and one fractional repetition: documents in a seeded random order until the rest of the
target is reached; the one document at the border gives only as many words as are missing. The running sums over a source go by 4,096 ranges of the seeded key, so
that a source with a third of all rows is dealt over that many groups; sums of the ranges are added before rows are shuffled.

Cases: null text has size 0; a null source is a source, the last one; a null doc_id has its own key; equal rows are documents in their own right and tie without effect;
a source without words gets target 0; an empty table gives no rows. Source rows are one per distinct source: the level is found in one task over that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialize, pick

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def plan(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(skey, source, source_size) to the same with `target` as double."""
    every = Window.partitionBy()
    n = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((n - 1) % len(weights) + 1).cast("int")).cast("double")
    before = Window.orderBy("fill", "skey").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every).cast("double") * share - upto[0]) / (F.sum("weight").over(every) - upto[1])
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * epochs)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(every)))
        .select("skey", "source_size", "target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and whole and part, the words taken by whole repetitions and by the fractional one; and the columns to keep, which
    order rows that tie otherwise."""
    sized = materialize(
        pick(docs, "doc_id", "text", "source", *keep).select(
            "doc_id",
            *keep,
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            "source",
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))).alias("key"),
        ),
        "mix-sizes",
    )
    rows = sized.withColumn("range", F.substring("key", 1, 3))
    ranges = rows.groupBy("skey", "source", "range").agg(F.sum("size").alias("range_size"))
    targets = plan(ranges.groupBy("skey", "source").agg(F.sum("range_size").alias("source_size")), weights, share, epochs)
    before = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bounds = ranges.select("skey", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start")).join(targets, "skey")
    earlier = Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    started = rows.withColumn("started", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - F.col("reps") * F.col("source_size")).cast("long")
    return (
        started.join(bounds, ["skey", "range"])
        .withColumn("reps", whole)
        .withColumn("part", F.greatest(F.lit(0), F.least("size", rest - F.col("range_start") - F.col("started"))))
        .select("doc_id", "size", "source_size", "target", (F.col("reps") * F.col("size") + F.col("part")).alias("taken"), "source", "reps", "part", *keep)
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '-')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size::DOUBLE * 2 AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS reps,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS started
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (reps * size + greatest(0, least(size, round(target - reps * source_size)::BIGINT - started)))::BIGINT AS taken, source, reps,
       greatest(0, least(size, round(target - reps * source_size)::BIGINT - started))::BIGINT AS part
FROM r
"""
