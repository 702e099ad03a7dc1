"""Selection and projection of spectra and peaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.functions import mass, text
from peakloom.functions.ordered import previous_row

Range = tuple[int, int]


def select_spectra(spectra: DataFrame, mz: Range, charge: Range, sqs: Range) -> DataFrame:
    """Inclusive ranges; an unknown quality passes."""
    return spectra.filter(
        F.col("mz_u").between(*mz)
        & F.col("charge").between(*charge)
        & (F.col("sqs").isNull() | F.col("sqs").between(*sqs))
    )


def select_by_mass(
    spectra: DataFrame, pm: Range, min_sqs: int, charge: int = 0, only_unassigned: bool = False, min_len: int = 4
) -> DataFrame:
    keep = F.col("pm_u").between(*pm) & (F.col("sqs").isNull() | (F.col("sqs") >= min_sqs))
    if charge > 0:
        keep = keep & (F.col("charge") == charge)
    if only_unassigned:
        keep = keep & (F.length("peptide") < min_len)
    return spectra.filter(keep)


def select_mz_range(spectra: DataFrame, lo: int, hi: int, charge: int) -> DataFrame:
    return spectra.filter(F.col("mz_u").between(lo, hi) & (F.col("charge") == charge))


def keep_annotated(spectra: DataFrame, min_len: int = 4) -> DataFrame:
    return spectra.filter(F.length("peptide") >= min_len)


def drop_modified(spectra: DataFrame) -> DataFrame:
    """Drop peptides that carry a mass shift such as ``M+16``."""
    return spectra.filter(~F.col("peptide").rlike("[A-Z][+-][0-9]"))


def peak_counts(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("n_peaks"))


def min_peaks(spectra: DataFrame, peaks: DataFrame, n: int = 5) -> DataFrame:
    return spectra.join(peak_counts(peaks).filter(F.col("n_peaks") >= n), "spectrum_id")


def dedup_adjacent(spectra: DataFrame, eps: int, chunk: int = 4096) -> DataFrame:
    """Drop a row whose predecessor in its file has the same peak count and nearly the same m/z."""
    prev = previous_row(
        spectra,
        ["file_idx"],
        F.floor(F.col("spectrum_id") / chunk),
        F.col("spectrum_id"),
        {"_pm": F.col("mz_u"), "_pn": F.col("n_peaks")},
    )
    same = (F.col("_pn") == F.col("n_peaks")) & (F.abs(F.col("mz_u") - F.col("_pm")) <= eps)
    return prev.filter(~F.coalesce(same, F.lit(False))).drop("_pm", "_pn")


def dedup_scan(scans: DataFrame, chunk: int = 4096) -> DataFrame:
    """Drop a header whose predecessor in the file has the same scan number."""
    prev = previous_row(
        scans, ["file_idx"], F.floor(F.col("row_id") / chunk), F.col("row_id"), {"_ps": F.col("scan")}
    )
    return prev.filter(F.col("_ps").isNull() | (F.col("_ps") != F.col("scan"))).drop("_ps")


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by a seeded hash of the key.

    Hash buckets are counted first; only the bucket holding the n-th row is ranked, so
    no task ever sees the whole table however large ``n`` is.
    """
    hashed = df.withColumn("_h", text.hash_hex(F.col(key), F.lit(seed))).withColumn(
        "_hb", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    )
    counts = hashed.groupBy("_hb").agg(F.count(F.lit(1)).alias("_n"))
    # at most 4096 rows
    before = counts.select(
        "_hb", F.coalesce(F.sum("_n").over(W.orderBy("_hb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), "_n"
    ).filter(F.col("_before") < n)
    whole = before.filter(F.col("_before") + F.col("_n") <= n).select("_hb")
    edge = before.filter(F.col("_before") + F.col("_n") > n).select("_hb", (F.lit(n) - F.col("_before")).alias("_take"))
    inside = hashed.join(F.broadcast(whole), "_hb", "left_semi").select(df.columns)
    rn = F.row_number().over(W.partitionBy("_hb").orderBy("_h", key))
    partial = (
        hashed.join(F.broadcast(edge), "_hb").withColumn("_rn", rn).filter(F.col("_rn") <= F.col("_take")).select(df.columns)
    )
    return inside.unionByName(partial)


def sample_per_charge(spectra: DataFrame, quota: Mapping[int, int]) -> DataFrame:
    """The first rows of each charge up to its quota; the group limit runs map side."""
    limit = F.coalesce(*[F.when(F.col("charge") == c, F.lit(q)) for c, q in quota.items()], F.lit(0))
    rn = F.row_number().over(W.partitionBy("charge").orderBy("spectrum_id"))
    return (
        spectra.withColumn("_rn", rn)
        .filter(F.col("_rn") <= max(quota.values()))
        .filter(F.col("_rn") <= limit)
        .drop("_rn")
    )


def exclude_mz_ranges(peaks: DataFrame, ranges: Sequence[Range]) -> DataFrame:
    hit = F.lit(False)
    for lo, hi in ranges:
        hit = hit | F.col("mass_u").between(lo, hi)
    return peaks.filter(~hit)


def best_charge_quality(quality: DataFrame) -> DataFrame:
    """Best charge per spectrum: highest probability, lower charge on ties."""
    best = F.max(F.struct("prob", (-F.col("charge")).alias("neg"))).alias("b")
    return quality.groupBy("spectrum_id").agg(best).select(
        "spectrum_id", (-F.col("b.neg")).cast("int").alias("best_charge"), F.col("b.prob").alias("prob")
    )


def filter_quality(spectra: DataFrame, quality: DataFrame, min_prob: int) -> DataFrame:
    keep = best_charge_quality(quality).filter(F.col("prob") >= min_prob)
    return spectra.join(keep, "spectrum_id")


def max_precursor(spectra: DataFrame, max_pm: int) -> DataFrame:
    return spectra.filter(F.col("pm_u") <= max_pm) if max_pm > 0 else spectra


def sanity_check(spectra: DataFrame, peaks: DataFrame, stored_counts: DataFrame, chunk: int = 4096) -> DataFrame:
    """Violations per spectrum: unordered masses, non-positive mass, negative intensity, wrong count."""
    seen = previous_row(
        peaks.select("spectrum_id", "mass_u", "intensity", "pos"),
        ["spectrum_id"],
        F.floor(F.col("pos") / chunk),
        F.struct("pos", "mass_u"),
        {"_pm": F.col("mass_u")},
    )
    agg = seen.groupBy("spectrum_id").agg(
        F.count_if(F.col("mass_u") <= F.col("_pm")).alias("unordered"),
        F.count_if(F.col("mass_u") <= 0).alias("bad_mass"),
        F.count_if(F.col("intensity") < 0).alias("bad_intensity"),
        F.count(F.lit(1)).alias("n_read"),
    )
    return (
        spectra.select("spectrum_id")
        .join(stored_counts, "spectrum_id", "left")
        .join(agg, "spectrum_id", "left")
        .select(
            "spectrum_id",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("unordered", "bad_mass", "bad_intensity", "n_read")],
            (F.coalesce("n_read", F.lit(0)) != F.coalesce("n_stored", F.lit(0))).alias("count_differs"),
        )
        .filter((F.col("unordered") + F.col("bad_mass") + F.col("bad_intensity") > 0) | F.col("count_differs"))
    )


def mass_for_charges(spectra: DataFrame, max_charge: int = 4) -> DataFrame:
    return spectra.withColumn("as_charge", F.explode(F.sequence(F.lit(1), F.lit(max_charge)))).withColumn(
        "as_pm_u", mass.precursor_mass(F.col("mz_u"), F.col("as_charge")).cast("bigint")
    )


def with_total_intensity(peaks: DataFrame) -> DataFrame:
    """Adds the total per spectrum: aggregated map side and joined back, so AQE can split a hot spectrum."""
    totals = peaks.groupBy("spectrum_id").agg(F.sum("intensity").alias("total"))
    return peaks.join(totals, "spectrum_id")


def normalize_intensity(peaks: DataFrame, total: int = 1000) -> DataFrame:
    return with_total_intensity(peaks).withColumn(
        "norm", F.when(F.col("total") > 0, F.col("intensity") * total / F.col("total")).otherwise(F.col("intensity").cast("double"))
    )


def log_tic_intensity(peaks: DataFrame) -> DataFrame:
    scaled = F.col("intensity") * 1000 / F.col("total")
    return with_total_intensity(peaks).withColumn(
        "log_tic", F.when(F.col("total") > 0, F.log(scaled)).otherwise(F.col("intensity").cast("double"))
    )


def extra_pm_candidates(spectra: DataFrame, offsets: Sequence[int], half_tol: int, second: Column) -> DataFrame:
    """Base and second mass, then offsets of the base and a proton step of the second,
    each kept only when no earlier candidate lies within half the tolerance."""
    base = F.col("pm_u")
    proposed = F.array(
        *[base + o for o in offsets],
        F.when(F.col("charge") >= 2, second - mass.PROTON),
        F.when(F.col("charge") >= 3, second + mass.PROTON),
    )
    kept = F.aggregate(
        F.filter(proposed, lambda x: x.isNotNull()),
        F.array(base, second),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(x - y) < half_tol), acc).otherwise(
            F.concat(acc, F.array(x))
        ),
    )
    return spectra.select("spectrum_id", "charge", F.posexplode(kept).alias("idx", "cand_u"))
