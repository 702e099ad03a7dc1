"""Key joins, set operations and collection counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from peakloom.functions import mass
from peakloom.functions.ordered import order_statistics, value_levels

SCAN_KEY = ["generation", "file_idx", "scan"]


def annotate(spectra: DataFrame, annotations: DataFrame, max_diff: int, how: str = "inner") -> DataFrame:
    """Attach charge and peptide by (file, scan) with a mismatch flag for far-off masses.

    ``annotations``: file_idx, scan, ann_charge, ann_peptide.
    """
    theo_mh = mass.peptide_mass(F.col("ann_peptide")) + mass.WATER_PROTON
    joined = spectra.join(annotations, ["file_idx", "scan"], how)
    theo_mz = mass.precursor_mz(theo_mh, F.col("ann_charge"))
    return joined.withColumn("theo_mz_u", theo_mz).withColumn(
        "mismatch", F.abs(F.col("theo_mz_u") - F.col("mz_u")) > max_diff
    )


def exclude_scans(scans: DataFrame, keys: DataFrame) -> DataFrame:
    return scans.join(keys, SCAN_KEY, "left_anti")


def include_scans(scans: DataFrame, keys: DataFrame) -> DataFrame:
    return scans.join(keys, SCAN_KEY, "left_semi")


def source_coverage(scans: DataFrame) -> DataFrame:
    """Scan range, distinct scans and repeated scans per (generation, file); counted in two
    steps so that a hot file is first collapsed map side."""
    per_scan = scans.groupBy(*SCAN_KEY).agg(F.count(F.lit(1)).alias("n"))
    return per_scan.groupBy("generation", "file_idx").agg(
        F.min("scan").alias("min_scan"),
        F.max("scan").alias("max_scan"),
        F.count(F.lit(1)).alias("n_scans"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.sum("n").alias("n_rows"),
    )


def union_collections(parts: Sequence[DataFrame]) -> DataFrame:
    tagged = [p.withColumn("source_idx", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged)


def intersection(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def minus_keep_duplicates(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def distinct_sequences(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("seq").agg(F.max("score").alias("score"))


def collection_stats(spectra: DataFrame) -> DataFrame:
    """Counts and ranges by charge and file type with subtotals (grouping level 0..3)."""
    return spectra.cube("charge", "file_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("mz_u").alias("min_mz_u"),
        F.max("mz_u").alias("max_mz_u"),
        F.min("charge").alias("min_charge"),
        F.max("charge").alias("max_charge"),
        F.grouping_id().cast("int").alias("level"),
    )


def mass_ventiles(spectra: DataFrame, steps: int = 20) -> DataFrame:
    """Precursor mass at each 1/steps of the rows of a charge (0-based rank total*i/steps)."""
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(steps - 1)),
        lambda i: F.struct(i.alias("pick"), (F.floor(F.col("total") * i / steps) + 1).alias("k")),
    )
    return order_statistics(spectra, ["charge"], F.col("pm_u"), picks)


def size_thresholds(
    spectra: DataFrame,
    small: int = 5_000,
    medium: int = 20_000,
    large: int = 50_000,
    per_class: int = 16_000,
    max_classes: int = 5,
    min_gap: int = 2_000_000,
    grid: int = 100_000,
) -> DataFrame:
    """Mass thresholds that cut the spectra of a charge into classes.

    Rows: charge, idx, threshold. A charge without rows has one open class. Large charges
    take up to ``max_classes`` classes at least ``min_gap`` apart, each next cut aiming at an
    equal share of the remaining rows; at most ``max_classes - 1`` passes over the distinct
    masses are made, never over the spectra.
    """
    levels = value_levels(spectra, ["charge"], F.col("pm_u"), 10_000)
    total = F.col("total")
    ranks = (
        F.when(total < small, F.array().cast("array<bigint>"))
        .when(total < medium, F.array(F.floor(total / 2)))
        .when(total < large, F.array(F.floor(total / 3), F.floor(total / 3) * 2))
        .otherwise(F.array().cast("array<bigint>"))
    )
    fixed = (
        levels.select("*", F.posexplode(ranks).alias("idx", "k"))
        .filter((F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("n")))
        .select("charge", "idx", F.col("level").alias("threshold"))
    )
    big = levels.filter(total >= large)
    classes = F.least(F.lit(max_classes), F.floor(total / per_class))
    state = (
        big.groupBy("charge")
        .agg(F.first("total").alias("total"))
        .select("charge", "total", classes.alias("classes"))
        .filter(F.col("classes") > 1)
        .select("*", F.floor(F.col("total") / F.col("classes")).alias("next"), F.lit(0).cast("bigint").alias("last"))
    )
    parts = [fixed]
    for step in range(max_classes - 1):
        hit = (
            state.join(big.select("charge", "level", "below", "n"), "charge")
            .filter((F.col("level") - F.col("last") > min_gap) & (F.col("below") + F.col("n") > F.col("next")))
            .groupBy("charge", "total", "classes")
            .agg(F.min(F.struct("level", F.greatest("below", "next").alias("at"))).alias("h"))
        )
        parts.append(hit.select("charge", F.lit(step).alias("idx"), (F.floor(F.col("h.level") / grid) * grid).alias("threshold")))
        left = F.col("total") - F.col("h.at")
        state = hit.filter((F.lit(step + 1) < F.col("classes") - 1) & (left >= 1.5 * per_class)).select(
            "charge",
            "total",
            "classes",
            (F.col("h.at") + F.floor(left / (F.col("classes") - (step + 1))) + 1).alias("next"),
            F.col("h.level").alias("last"),
        )
    return reduce(DataFrame.unionByName, parts)


def mz_bucket(mz: Column, width: int, max_mz: int) -> Column:
    return F.floor(F.least(mz, F.lit(max_mz)) / width).cast("bigint")
