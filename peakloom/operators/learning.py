"""Data work around statistical learning: weights, pairs, feature tables, splits.

``features``: sample_id, label, feature, value (long, sparse). ``weighted``: sample_id,
label, weight.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.functions import text
from peakloom.functions.ordered import order_statistics
from peakloom.operators.peaks import KEY


# --- probability models ---------------------------------------------------------------


def fit_probability(samples: DataFrame, inputs: Sequence[str], label: str, weight: str, classes: Sequence[str]):
    """A weighted logistic model per model class (size, charge ...). The classes are a short
    list known from a config table; each fit is a distributed job.

    Returns {class values: model}.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=list(inputs), outputCol="x").transform(samples)
    fitter = LogisticRegression(featuresCol="x", labelCol=label, weightCol=weight, maxIter=25, regParam=0.01)
    models = {}
    for row in samples.select(*classes).distinct().orderBy(*classes).toLocalIterator():
        part = ready
        for c in classes:
            part = part.filter(F.col(c) == row[c])
        models[tuple(row)] = fitter.fit(part.select("x", label, weight))
    return models


def predict_probability(samples: DataFrame, models: Mapping, inputs: Sequence[str], classes: Sequence[str], offset: float, factor: float) -> DataFrame:
    """Probability from the fitted coefficients, then (p + offset) * factor, not below zero.

    The coefficients become a small literal, so all classes are scored in one pass.
    """
    score = F.lit(None).cast("double")
    for key, model in models.items():
        match = F.lit(True)
        for c, v in zip(classes, key):
            match = match & (F.col(c) == v)
        linear = F.lit(float(model.intercept))
        for name, w in zip(inputs, model.coefficients):
            linear = linear + F.col(name) * float(w)
        score = F.when(match, 1.0 / (1.0 + F.exp(-linear))).otherwise(score)
    return samples.withColumn("prob", score).withColumn("corrected", F.greatest((F.col("prob") + offset) * factor, F.lit(0.0)))


# --- charges ----------------------------------------------------------------------------


def _per_charge(quality: DataFrame) -> DataFrame:
    """One row per spectrum with its charge scores, best first; at most one entry per charge."""
    items = F.sort_array(F.collect_list(F.struct("prob", (-F.col("charge")).alias("neg"))), asc=False)
    return quality.groupBy(KEY).agg(items.alias("c"))


def charge_comparison(quality: DataFrame) -> DataFrame:
    """Per charge the smallest pairwise probability against the other charges."""
    pair = lambda x, y: F.when(x["prob"] + y["prob"] > 0, x["prob"] / (x["prob"] + y["prob"])).otherwise(0.5)
    rows = F.transform(
        "c",
        lambda x: F.struct(
            (-x["neg"]).cast("int").alias("charge"),
            F.array_min(F.transform(F.filter("c", lambda y: y["neg"] != x["neg"]), lambda y: pair(x, y))).alias("min_prob"),
        ),
    )
    return _per_charge(quality).select(KEY, F.inline(rows))


def best_charge(quality: DataFrame) -> DataFrame:
    """Best and second best charge with the gap between their scores."""
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    return _per_charge(quality).select(
        KEY,
        (-first["neg"]).cast("int").alias("best"),
        (-second["neg"]).cast("int").alias("second"),
        (first["prob"] - second["prob"]).alias("gap"),
    )


# --- preference pairs ---------------------------------------------------------------------


def preference_pairs(items: DataFrame, group: str, item: Sequence[str]) -> DataFrame:
    """Ordered pairs of a group's items, weighted by their difference and the stronger one.

    With intensities relative to the strongest item, a pair weighs 0.6 x difference + 0.4 x stronger, at
    most 1. Pairs closer than 0.85 in ratio are left out, and so are weights below 0.1, or below 0.25 when
    the weaker item has no intensity. ``points`` is the weight in tenths of the strongest intensity. A group is the matched fragments of one peptide, bounded by its cuts times the ion
    table, so its pairs are formed inside one row. ``items``: group, item columns,
    intensity, score.
    """
    one = F.struct(*item, "intensity", "score")
    lists = items.groupBy(group).agg(F.sort_array(F.collect_list(one)).alias("items"), F.max("intensity").alias("top"))
    side = lambda x, s: [x[c].alias(f"{c}_{s}") for c in item]

    def points(a: Column, b: Column) -> Column:
        return 6 * (a["intensity"] - b["intensity"]) + 4 * a["intensity"]

    def worth(a: Column, b: Column) -> Column:
        apart = (b["intensity"] < a["intensity"]) & (b["intensity"] * 100 <= a["intensity"] * 85)
        floor = F.when(b["intensity"] == 0, 5).otherwise(2) * F.col("top")
        return apart & (2 * points(a, b) >= floor)

    pairs = F.flatten(
        F.transform(
            "items",
            lambda a: F.transform(
                F.filter("items", lambda b: worth(a, b)),
                lambda b: F.struct(
                    *side(a, "hi"),
                    *side(b, "lo"),
                    points(a, b).alias("points"),
                    F.least(F.lit(1.0), points(a, b) / (10 * F.col("top"))).alias("weight"),
                    (a["score"] <= b["score"]).alias("wrong"),
                ),
            ),
        )
    )
    return lists.select(group, F.inline(pairs))


def pairwise_rank_error(pairs: DataFrame, group: str) -> DataFrame:
    """Share of pair weight that is ordered wrongly; equal scores count as wrong.

    The normaliser of a group cancels, so the whole points are summed.
    """
    return pairs.groupBy(group).agg(
        (F.sum(F.when(F.col("wrong"), F.col("points")).otherwise(0)) / F.sum("points")).alias("error")
    )


def misordered_pairs(pairs: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The n heaviest wrongly ordered pairs; the limit is the report."""
    return pairs.filter("wrong").orderBy(F.round("weight", 9).desc(), *order).limit(n)


def rank_error_report(items: DataFrame, group: str, tie: Sequence[str], top: int) -> DataFrame:
    """Mean and deviation of the predicted rank of the k-th strongest item, k = 1..top."""
    true = W.partitionBy(group).orderBy(F.desc("intensity"), *tie)
    pred = W.partitionBy(group).orderBy(F.desc("score"), *tie)
    ranked = items.withColumn("k", F.row_number().over(true)).withColumn("p", F.row_number().over(pred))
    return ranked.filter(F.col("k") <= top).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_rank"), F.stddev_pop("p").alias("sd_rank")
    )


# --- feature tables -------------------------------------------------------------------------


def feature_bins(features: DataFrame, bins: int, min_samples: int) -> DataFrame:
    """Equi-populated upper limits per feature; features with few samples get none."""
    enough = F.col("total") >= min_samples
    ranks = F.transform(
        F.sequence(F.lit(1), F.lit(bins - 1)),
        lambda i: F.struct(i.alias("pick"), F.greatest(F.floor(F.col("total") * i / bins), F.lit(1)).alias("k")),
    )
    picks = F.when(enough, ranks).otherwise(F.filter(ranks, lambda x: F.lit(False)))
    return order_statistics(features, ["feature"], F.col("value"), picks, 64).select("feature", "pick", F.col("value").alias("limit"))


def additive_score(features: DataFrame, limits: DataFrame, weights: Mapping[str, float], step: float, default: float) -> DataFrame:
    """Binary weight of each active feature plus its bin's weight, minus a default.

    ``limits`` is a feature-by-bin table (bounded by the model, not by the samples), folded
    into one row per feature before the join.
    """
    table = limits.groupBy("feature").agg(F.sort_array(F.collect_list("limit")).alias("limits"))
    base = F.coalesce(*[F.when(F.col("feature") == f, F.lit(w)) for f, w in weights.items()], F.lit(0.0))
    slot = F.size(F.filter(F.coalesce("limits", F.array().cast("array<bigint>")), lambda x: F.col("value") > x))
    part = F.when(F.col("value") != 0, base).otherwise(0.0) + slot * step
    return (
        features.join(table, "feature", "left")
        .groupBy("sample_id")
        .agg((F.sum(part) - default).alias("score"))
    )


def feature_summary(features: DataFrame) -> DataFrame:
    """Levels first, then one row per feature, so that a popular feature is reduced map side."""
    levels = features.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return levels.groupBy("feature").agg(
        F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)).alias("n_zero"),
        F.sum(F.when(F.col("value") != 0, F.col("n")).otherwise(0)).alias("n_active"),
        F.count(F.lit(1)).alias("n_values"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def best_weak_feature(features: DataFrame, potential: Column) -> DataFrame:
    """The feature with the largest absolute sum of potentials over its active samples."""
    sums = features.filter("value <> 0").groupBy("feature").agg(F.sum(potential).alias("potential"))
    return sums.orderBy(F.abs("potential").desc(), "feature").limit(1)


def train_partitions(rows: DataFrame, keys: Sequence[str], key: str, test_hex: str, min_size: int, seed: int) -> DataFrame:
    """Rows per class with a hash split and a flag for classes that are too small."""
    is_test = F.substring(text.hash_hex(F.col(key), F.lit(seed)), 1, 4) < test_hex
    counts = rows.groupBy(*keys).agg(F.count_if(is_test).alias("n_test"), F.count_if(~is_test).alias("n_train"))
    return counts.withColumn("enough", F.col("n_train") >= min_size)


def negative_weights(rows: DataFrame, source: str, correct_share: Column, shares: Mapping) -> DataFrame:
    """1 - correct share, scaled so that each source holds its share of the total row count."""
    w = rows.withColumn("w", 1 - correct_share)
    sums = w.groupBy(source).agg(F.sum("w").alias("sw"), F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.sum("n").alias("total"))
    want = F.coalesce(*[F.when(F.col(source) == s, F.lit(v)) for s, v in shares.items()], F.lit(0.0))
    factor = sums.crossJoin(F.broadcast(whole)).select(source, (want * F.col("total") / F.col("sw")).alias("factor"))
    return w.join(factor, source).withColumn("weight", F.col("w") * F.col("factor")).drop("w", "factor")


def path_probability_features(probs: Column) -> list[Column]:
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    low = F.array_sort(probs)
    return [(total / F.size(probs)).alias("mean_prob"), F.get(low, F.lit(0)).alias("lowest"), F.get(low, F.lit(1)).alias("second_lowest")]


def predicted_peaks(expected: DataFrame, score: Column, n: int) -> DataFrame:
    """The n best scored theoretical peaks of each peptide with their m/z."""
    rn = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("score"), "ion", "cut"))
    return expected.withColumn("score", score).withColumn("rank", rn.cast("bigint")).filter(F.col("rank") <= n)


def split_set(rows: DataFrame, key: str, test_hex: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) with no key in both, by a seeded hash of the key."""
    is_test = F.substring(text.hash_hex(F.col(key), F.lit(seed)), 1, 4) < test_hex
    return rows.filter(~is_test), rows.filter(is_test)


def calibrate_class_weights(weighted: DataFrame, zero_share: float, total: float) -> DataFrame:
    """Class 0 gets its share of the weight and the sum of all weights becomes ``total``."""
    sums = weighted.groupBy("label").agg(F.sum("weight").alias("sw"))
    want = F.when(F.col("label") == 0, zero_share).otherwise(1 - zero_share) * total
    factor = sums.select("label", (want / F.col("sw")).alias("factor"))
    return weighted.join(F.broadcast(factor), "label").withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")


def purge_rare_features(features: DataFrame, min_count: int, classes: Sequence[int]) -> DataFrame:
    """Drop a feature that is active somewhere but too rarely in one of the classes."""
    active = F.col("value") != 0
    counts = features.groupBy("feature").agg(
        F.count_if(active).alias("n"), *[F.count_if(active & (F.col("label") == c)).alias(f"n{c}") for c in classes]
    )
    short = F.lit(False)
    for c in classes:
        short = short | (F.col(f"n{c}") < min_count)
    rare = counts.filter((F.col("n") > 0) & short).select("feature")
    return features.join(rare, "feature", "left_anti")


def match_feature_share(weighted: DataFrame, holders: DataFrame, label: int, share: float) -> DataFrame:
    """Scale the weights of a label's rows that hold a feature so that they make up ``share``.

    With A the weight of the holders and B that of the rest of the label, the factor is
    share * B / ((1 - share) * A), kept in [0.2, 5].
    """
    flagged = weighted.join(holders.select("sample_id").distinct().withColumn("has", F.lit(1)), "sample_id", "left")
    mine = F.col("label") == label
    sums = flagged.agg(
        F.sum(F.when(mine & F.col("has").isNotNull(), F.col("weight"))).alias("a"),
        F.sum(F.when(mine & F.col("has").isNull(), F.col("weight"))).alias("b"),
    )
    raw = F.col("b") * share / (F.col("a") * (1 - share))
    factor = sums.select(F.coalesce(F.greatest(F.lit(0.2), F.least(F.lit(5.0), raw)), F.lit(1.0)).alias("factor"))
    # one row
    return (
        flagged.crossJoin(F.broadcast(factor))
        .withColumn("weight", F.when(mine & F.col("has").isNotNull(), F.col("weight") * F.col("factor")).otherwise(F.col("weight")))
        .select("sample_id", "label", "weight")
    )


def feature_statistics(features: DataFrame, weighted: DataFrame) -> DataFrame:
    """Weighted zero share and mean value by feature and class."""
    joined = features.join(weighted.select("sample_id", "weight"), "sample_id")
    return joined.groupBy("feature", "label").agg(
        (F.sum(F.when(F.col("value") == 0, F.col("weight")).otherwise(0)) / F.sum("weight")).alias("zero_share"),
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean_value"),
        F.count(F.lit(1)).alias("n"),
    )


# Grid steps from the positive row at which negatives are taken.
NEGATIVE_STEPS = (4, 5, 7, 9, 10, 15, 19, 20)
RANDOM_NEGATIVES, RANDOM_DISTANCE = 5, 6


def grid_negatives(grid: DataFrame, truth: DataFrame, step: int) -> DataFrame:
    """The grid row nearest to the truth is positive; rows at fixed steps from it are negative.

    Of five rows drawn by a hash those at least six steps away are negative, too. A grid is bounded.

    ``grid``: spectrum_id, grid. ``truth``: spectrum_id, truth_u.
    """
    dist = F.abs(F.col("grid") * step - F.col("truth_u"))
    best = (
        grid.join(truth, KEY).groupBy(KEY).agg(F.min(F.struct(dist.alias("d"), "grid")).alias("b")).select(KEY, F.col("b.grid").alias("positive"))
    )
    lot = F.md5(F.concat_ws(":", KEY, "grid").cast("binary"))
    drawn = F.row_number().over(W.partitionBy(KEY).orderBy(lot, "grid")) <= RANDOM_NEGATIVES
    joined = grid.select(KEY, "grid").join(best, KEY).withColumn("drawn", drawn)
    away = F.abs(F.col("grid") - F.col("positive"))
    return joined.filter((away == 0) | away.isin(*NEGATIVE_STEPS) | (F.col("drawn") & (away >= RANDOM_DISTANCE))).select(KEY, "grid", (away == 0).cast("int").alias("label"))


def candidate_sets(positives: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of each positive, I read as L, without the positive itself and without repeats.

    ``positives``: file_idx, scan, peptide. ``candidates``: file_idx, scan, seq, score.
    """
    plain = lambda c: F.translate(c, "I", "L")
    pos = positives.select("file_idx", "scan", plain(F.col("peptide")).alias("positive"))
    cand = (
        candidates.select("file_idx", "scan", plain(F.col("seq")).alias("seq"), "score")
        .groupBy("file_idx", "scan", "seq")
        .agg(F.max("score").alias("score"))
    )
    return pos.join(cand, ["file_idx", "scan"]).filter(F.col("seq") != F.col("positive"))


def select_examples(rows: DataFrame, charge: int, mobility: str, length: tuple[int, int], pm: tuple[int, int]) -> DataFrame:
    return rows.filter(
        (F.col("charge") == charge)
        & (F.col("mobility") == mobility)
        & F.length("peptide").between(*length)
        & F.col("pm_u").between(*pm)
    )


def down_sample(features: DataFrame, rows: DataFrame, label: int, feature: str, drop_hex: str, seed: int) -> DataFrame:
    """Drop a hash-chosen part of a label's samples that hold a feature."""
    holders = features.filter((F.col("feature") == feature) & (F.col("value") != 0)).select("sample_id").distinct()
    chosen = F.substring(text.hash_hex(F.col("sample_id"), F.lit(seed)), 1, 4) < drop_hex
    gone = rows.filter((F.col("label") == label) & chosen).select("sample_id").join(holders, "sample_id", "left_semi")
    return rows.join(gone, "sample_id", "left_anti")
