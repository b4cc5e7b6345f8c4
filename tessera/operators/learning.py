"""What the selector's training and evaluation compute over rows: label ids, class weights, standardisation, thresholds, scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Power of the class weights; number and ends of the thresholds' quantiles; least deviation that divides.
POWER, QUANTILES, LOW, HIGH, LEAST = 0.15, 15, 0.05, 0.95, 1e-6


def label_space(rows: DataFrame, label: str) -> DataFrame:
    """(label, y) with y from 0 in label order. One row for each label is sorted in one task: labels are few."""
    names = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return names.withColumn("y", F.row_number().over(Window.orderBy("label")) - 1)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight), (mean count / count)^0.15 scaled to mean 1. The windows are over one row for each label."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return counts.withColumn("w", F.pow(F.avg("n").over(every) / F.col("n"), F.lit(POWER))).select("label", "n", (F.col("w") / F.avg("w").over(every)).alias("weight"))


def column_stats(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std), population deviation, 1 where it is under 1e-6. All columns in one pass."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in columns]
    found = rows.agg(F.array(*pairs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return found.withColumn("std", F.when(F.col("std") < LEAST, 1.0).otherwise(F.col("std")))


def thresholds(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, place, threshold), 15 linearly interpolated quantiles from 0.05 to 0.95. Exact: counts of distinct values are merged, so its memory grows with these."""
    steps = [LOW + (HIGH - LOW) * i / (QUANTILES - 1) for i in range(QUANTILES)]
    pairs = [F.struct(F.lit(c).alias("feature"), F.percentile(c, F.array(*map(F.lit, steps))).alias("t")) for c in columns]
    found = rows.agg(F.array(*pairs).alias("a")).select(F.explode("a").alias("r"))
    return found.select("r.feature", F.posexplode("r.t").alias("place", "threshold"))


def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """A24 for the first place: (n, accuracy)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def f1_by_label(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """A26 before its mean: (label, f1) over labels of either column, 0 where undefined. Rows are summed to label pairs first."""
    pairs = rows.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.col("n"), hit.alias("hit")), F.struct(F.col("p").alias("label"), F.col("n"), F.lit(0).cast("long").alias("hit")))).alias("r"))
    return sides.select("r.*").groupBy("label").agg((2 * F.sum("hit") / F.sum("n")).alias("f1"))


def macro_f1(rows: DataFrame, label: str, predicted: str, space: DataFrame | None = None) -> DataFrame:
    """A26 over the labels of `space` (label), those that no row has counting 0; over the labels seen, if it isn't given."""
    found = f1_by_label(rows, label, predicted)
    if space is not None:
        found = F.broadcast(space.select("label")).join(found, "label", "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))
    return found.agg(F.avg("f1").alias("macro_f1"))


def ranked(scores: DataFrame) -> DataFrame:
    """(id, label, score) with `rank` from 1, the highest score first and the first label at ties. One row's labels are few."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "label")))


def top_k_accuracy(scores: DataFrame, truth: DataFrame, k: int = 2) -> DataFrame:
    """(n, accuracy, top) of scores (id, label, score) and truth (id, y)."""
    place = F.min(F.when(F.col("label") == F.col("y"), F.col("rank")))
    found = ranked(scores).join(truth, "id").groupBy("id").agg(place.alias("place"))
    share = lambda n: F.avg(F.coalesce(F.col("place") <= n, F.lit(False)).cast("double"))
    return found.agg(F.count(F.lit(1)).alias("n"), share(1).alias("accuracy"), share(k).alias("top"))


def valid(results: DataFrame) -> DataFrame:
    """Results that didn't fail and have a ratio."""
    return results.where(F.coalesce("ok", F.lit(True)) & F.col("ratio").isNotNull())


def utility(results: DataFrame) -> DataFrame:
    """Each valid result's ratio over the best of its slice."""
    best = F.max("ratio").over(Window.partitionBy("id"))
    return valid(results).withColumn("utility", F.col("ratio") / F.greatest(best, F.lit(1e-12)))


def relative_ratio(results: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mean of what the chosen pipelines (id, label) get over the best of each slice; 0 for one that isn't valid."""
    good = valid(results)
    best = good.groupBy("id").agg(F.max("ratio").alias("best"))
    got = chosen.join(good.select("id", F.col("pipeline").alias("label"), "ratio"), ["id", "label"], "left").join(best, "id")
    return got.agg(F.avg(F.coalesce("ratio", F.lit(0.0)) / F.greatest("best", F.lit(1e-12))).alias("relative_ratio"))


def targets(items: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """For items (id, label) whose label is known, one row for each label with its ratio and mask; an item without a valid ratio has 1 and 1 at its own label."""
    known = items.join(F.broadcast(labels.select("label")), "label", "left_semi").withColumnRenamed("label", "own")
    pairs = known.crossJoin(F.broadcast(labels.select("label")))
    found = pairs.join(valid(results).select("id", F.col("pipeline").alias("label"), "ratio"), ["id", "label"], "left")
    some = F.count("ratio").over(Window.partitionBy("id")) > 0
    own = ~some & (F.col("label") == F.col("own"))
    return found.select("id", "own", "label", F.when(own, 1.0).otherwise(F.coalesce("ratio", F.lit(0.0))).alias("ratio"), (F.col("ratio").isNotNull() | own).cast("int").alias("mask"))


def masked_scores(scores: DataFrame) -> DataFrame:
    """The score of a label that isn't valid is a billion below zero."""
    return scores.withColumn("score", F.when(F.col("mask") == 0, -1e9).otherwise(F.col("score")))


def unseen(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Labels of test that train hasn't."""
    return test.select(label).where(F.col(label).isNotNull()).distinct().join(train.select(label).distinct(), label, "left_anti")


def ensemble(members: DataFrame) -> DataFrame:
    """Mean score over members (member, id, label, score)."""
    return members.groupBy("id", "label").agg(F.avg("score").alias("score"))


def best_alpha(scored: DataFrame, truth: DataFrame, results: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """(alpha, accuracy, relative_ratio) of score = cls + alpha * util for each alpha, the best first; the alphas are few."""
    spark = scored.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(a),) for a in alphas], "alpha double"))
    every = scored.crossJoin(grid).withColumn("score", F.col("cls") + F.col("alpha") * F.col("util"))
    first = F.max_by("label", F.struct(F.col("score"), -F.col("place")))
    picked = every.groupBy("alpha", "id").agg(first.alias("label")).join(truth, "id")
    good = valid(results)
    best = good.groupBy("id").agg(F.max("ratio").alias("best"))
    got = picked.join(good.select("id", F.col("pipeline").alias("label"), "ratio"), ["id", "label"], "left").join(best, "id", "left")
    scores = got.groupBy("alpha").agg(
        F.avg((F.col("label") == F.col("y")).cast("double")).alias("accuracy"), F.avg(F.coalesce(F.col("ratio") / F.greatest("best", F.lit(1e-12)), F.lit(0.0))).alias("relative_ratio")
    )
    return scores.orderBy(F.desc("accuracy"), F.desc("relative_ratio"), "alpha")


def binned(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, x): standardised columns, followed by 15 marks each, 1 where the value is over a threshold. Statistics are one row, sent to all."""
    stats = column_stats(rows, columns).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("stats"))
    cuts = thresholds(rows, columns).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("place", "threshold"))).alias("t"))
    cuts = cuts.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col("t.threshold")))).alias("cuts"))
    wide = rows.crossJoin(F.broadcast(stats.crossJoin(cuts)))
    z = [(F.col(c) - F.col("stats")[c]["mean"]) / F.col("stats")[c]["std"] for c in columns]

    def over(c: str) -> Column:
        return F.transform(F.col("cuts")[c], lambda t: (F.col(c) > t).cast("double"))

    marks = [over(c) for c in columns]
    return wide.select("id", F.concat(F.array(*z), *marks).alias("x"))


def train(rows: DataFrame, layers: Sequence[int], seed: int = 1, epochs: int = 100):
    """A multilayer perceptron over (x array, y double) by MLlib, in place of the residual network: one head, no weights of classes. Returns the fitted model, which writes itself."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=list(layers), seed=seed, maxIter=epochs).fit(data)


def scores_of(model, rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(id, label, score) of a fitted model for rows (id, x)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(rows.select("id", array_to_vector("x").alias("features"))).select("id", vector_to_array("probability").alias("p"))
    names = F.array(*map(F.lit, labels))
    return out.select("id", F.explode(F.arrays_zip(names.alias("label"), F.col("p").alias("score"))).alias("r")).select("id", "r.label", "r.score")
