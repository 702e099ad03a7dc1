"""Aggregates and reports over spectra, peaks and ion matches.

Ion matches are the rows of ``peaks.match_ions``: spectrum_id, peptide, cut, ion, status,
expected_u, mass_u, intensity, err_u.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.functions import mass
from peakloom.functions.band import band_join
from peakloom.functions.ordered import order_statistics, picked_levels, ranked_levels
from peakloom.operators.peaks import KEY, complement_pairs, complement_totals
from peakloom.session import cut_lineage

# Fixed values.
KERNEL = (10, 9, 6, 4, 2)


# --- tolerances and histograms -----------------------------------------------------


def _kept_rank(keep_percent: int) -> Column:
    rank = F.col("total") - F.floor(F.col("total") * (100 - keep_percent) / 100)
    return F.array(F.struct(F.lit(keep_percent).alias("pick"), rank.alias("k")))


def error_cutoff(errors: DataFrame, keys: Sequence[str], err: Column, keep_percent: int) -> DataFrame:
    """The absolute error left after dropping the largest (100 - keep) percent."""
    found = order_statistics(errors, keys, F.abs(err), _kept_rank(keep_percent))
    return found.select(*keys, F.col("value").alias("tol_u"), F.col("total").alias("n"))


def strongest_ions(matches: DataFrame, n: int = 2) -> DataFrame:
    """The ions with the largest observed intensity; one row per ion, a handful at most."""
    totals = matches.filter("status = 'observed'").groupBy("ion").agg(F.sum("intensity").alias("total"))
    return totals.orderBy(F.desc("total"), "ion").limit(n).select("ion")


def fragment_tolerance(matches: DataFrame, keep_percent: int) -> DataFrame:
    """``error_cutoff`` of the strongest ions. Matches are read once: they collapse to levels of ion and error, which are stored."""
    observed = matches.filter("status = 'observed'").groupBy("ion", "status", F.abs("err_u").alias("level"))
    levels = cut_lineage(observed.agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity")))
    best = F.broadcast(strongest_ions(levels))
    ranked = ranked_levels(levels.join(best, "ion", "left_semi").select("ion", "level", "n"), ["ion"], 10_000)
    return picked_levels(ranked, ["ion"], _kept_rank(keep_percent)).select("ion", F.col("value").alias("tol_u"), F.col("total").alias("n"))


def mass_error_bins(matches: DataFrame, width: int, half: int = 20) -> DataFrame:
    """2 * half + 1 bins of ion mass error; the outer bins are open."""
    bin_ = F.greatest(F.least(F.round(F.col("err_u") / width), F.lit(half)), F.lit(-half)).cast("int")
    return (
        matches.filter("status = 'observed'").groupBy("ion", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(df: DataFrame, value: Column, separators: Sequence[int]) -> DataFrame:
    """Counts between explicit separators (value at a separator goes up) with the share of all."""
    slot = reduce(lambda acc, s: acc + F.when(value >= s, 1).otherwise(0), separators, F.lit(0))
    counts = df.groupBy(slot.cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    # at most one row per separator plus one
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def mean_sd(df: DataFrame, keys: Sequence[str], value: Column, weight: Column) -> DataFrame:
    """Plain and weighted mean and population deviation from sums of W, WX and WX^2."""
    g = df.select(*keys, value.alias("x"), weight.alias("w")).groupBy(*keys)
    sums = g.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x").alias("sx"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum("w").alias("sw"),
        F.sum(F.col("w") * F.col("x")).alias("swx"),
        F.sum(F.col("w") * F.col("x") * F.col("x")).alias("swxx"),
    )

    def both(n: str, s: str, ss: str, name: str) -> list[Column]:
        m = F.col(s) / F.col(n)
        return [m.alias(f"{name}mean"), F.sqrt(F.greatest(F.col(ss) / F.col(n) - m * m, F.lit(0.0))).alias(f"{name}sd")]

    return sums.select(*keys, "n", *both("n", "sx", "sxx", ""), *both("sw", "swx", "swxx", "w"))


def mean_sd_from_counts(levels: DataFrame, keys: Sequence[str], value: Column, count: Column) -> DataFrame:
    """Mean and population deviation of values that come with their counts."""
    return mean_sd(levels, keys, value, count).select(*keys, F.col("wmean").alias("mean"), F.col("wsd").alias("sd"))


def pr_curve(levels: DataFrame) -> DataFrame:
    """Precision and recall per score level (``score``, ``n_target``, ``n_decoy``), best first."""
    down = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    t, d = F.sum("n_target").over(down), F.sum("n_decoy").over(down)
    return levels.select("score", (t / (t + d)).alias("precision"), (t / F.sum("n_target").over(W.partitionBy())).alias("recall"))


def pr_auc(curve: DataFrame, order: Column) -> DataFrame:
    """Trapezoid area; the curve starts at precision 1 and ends at precision 0."""
    w = W.orderBy(order)
    prev_p, prev_r = F.lag("precision", 1, 1.0).over(w), F.lag("recall", 1, 0.0).over(w)
    steps = curve.select("precision", "recall", ((F.col("recall") - prev_r) * (F.col("precision") + prev_p) * 0.5).alias("area"))
    tail = (1.0 - F.max("recall")) * 0.5 * F.max_by("precision", "recall")
    return steps.agg((F.sum("area") + tail).alias("auc"))


# --- offsets ------------------------------------------------------------------------


def peak_offsets(cuts: DataFrame, peaks: DataFrame, reach: int) -> DataFrame:
    """Offsets of peaks from prefix and suffix cut masses, within ``reach``."""
    ends = F.array(
        F.struct(F.lit("prefix").alias("orientation"), F.col("cut_u").alias("at_u")),
        F.struct(F.lit("suffix").alias("orientation"), (F.col("total_u") - F.col("cut_u")).alias("at_u")),
    )
    probe = cuts.select(KEY, "cut", F.inline(ends))
    near = band_join(probe, peaks.select(KEY, "mass_u"), [KEY], F.col("at_u") - reach, F.col("at_u") + reach, "mass_u", 2 * reach)
    return near.select(KEY, "cut", "orientation", "mass_u", (F.col("mass_u") - F.col("at_u")).alias("offset_u"))


def offset_histogram(offsets: DataFrame, width: int) -> DataFrame:
    """Kernel-smoothed counts per offset bin: offsets are counted first, then the bins spread."""
    raw = offsets.groupBy("orientation", F.floor(F.col("offset_u") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spread = F.array(
        *[
            F.struct(F.lit(d).alias("d"), F.lit(KERNEL[abs(d)]).cast("bigint").alias("k"))
            for d in range(1 - len(KERNEL), len(KERNEL))
        ]
    )
    return (
        raw.select("orientation", "bin", "n", F.inline(spread))
        .groupBy("orientation", (F.col("bin") + F.col("d")).alias("bin"))
        .agg(F.sum(F.col("n") * F.col("k")).alias("weight"))
    )


def offset_modes(hist: DataFrame, n: int, suppress: int) -> DataFrame:
    """Bins that lead all bins within ``suppress``, the n heaviest per orientation.

    The histogram has a fixed number of bins, so its windows are small.
    """
    near = W.partitionBy("orientation").orderBy("bin").rangeBetween(-suppress, suppress)
    lead = F.max(F.struct("weight", (-F.col("bin")).alias("neg"))).over(near)
    peaks = hist.withColumn("lead", lead).filter(F.col("lead.neg") == -F.col("bin"))
    rn = F.row_number().over(W.partitionBy("orientation").orderBy(F.desc("weight"), "bin"))
    return peaks.withColumn("rank", rn.cast("bigint")).filter(F.col("rank") <= n).select("orientation", "bin", "weight", "rank")


def random_peak_density(cuts: DataFrame, peaks: DataFrame, reach: int, tol: int) -> DataFrame:
    """Expected number of random peaks in a tolerance window, from the density around cuts."""
    probe = cuts.select(KEY, F.col("cut_u").alias("at_u"))
    near = band_join(probe, peaks.select(KEY, "mass_u"), [KEY], F.col("at_u") - reach, F.col("at_u") + reach, "mass_u", 2 * reach)
    total = cuts.agg(F.count(F.lit(1)).alias("n_cuts"))
    return total.crossJoin(near.agg(F.count(F.lit(1)).alias("n"))).select(
        "n_cuts", F.when(F.col("n_cuts") > 0, F.col("n") / F.col("n_cuts") / (2 * reach) * (2 * tol)).alias("expected")
    )


# --- ion statistics -------------------------------------------------------------------


def ion_probabilities(contexts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of visible cuts at which the ion is observed."""
    visible = contexts.filter("status <> 'not_visible'")
    seen = F.count_if(F.col("status") == "observed")
    return visible.groupBy(*keys, "ion").agg(F.count(F.lit(1)).alias("n_visible"), (seen / F.count(F.lit(1))).alias("prob"))


def ion_detection(matches: DataFrame, by: str) -> DataFrame:
    """Observed and total cuts per ion and class, with a row for all classes."""
    agg = matches.groupBy("ion", by).agg(
        F.count_if(F.col("status") == "observed").alias("observed"), F.count_if(F.col("status") != "not_visible").alias("total")
    )
    every = agg.groupBy("ion").agg(F.sum("observed").alias("observed"), F.sum("total").alias("total"))
    return agg.unionByName(every.withColumn(by, F.lit("all")))


def cross_table(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and class with a total per row, a totals row (``all``) and column shares."""
    counts = df.groupBy(F.col(row).cast("string").alias("row")).agg(
        *[F.count_if(F.col(col) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total")
    )
    names = [*values, "total"]
    sums = counts.agg(*[F.sum(c).alias(c) for c in names])
    whole = F.broadcast(sums.select([F.col(c).alias(f"_{c}") for c in names]))
    both = counts.unionByName(sums.withColumn("row", F.lit("all")))
    # the totals are one row
    return both.crossJoin(whole).select(
        "row", *names, *[F.when(F.col(f"_{v}") > 0, F.col(v) / F.col(f"_{v}")).otherwise(0.0).alias(f"share_{v}") for v in values]
    )


def explained_intensity(matches: DataFrame, peaks: DataFrame) -> DataFrame:
    used = matches.filter("status = 'observed'").select(KEY, "mass_u", "intensity").distinct()
    explained = used.groupBy(KEY).agg(F.sum("intensity").alias("explained"))
    totals = peaks.groupBy(KEY).agg(F.sum("intensity").alias("total"))
    return totals.join(explained, KEY, "left").select(KEY, (F.coalesce("explained", F.lit(0)) / F.col("total")).alias("share"))


def observed_expected(matches: DataFrame) -> DataFrame:
    return matches.groupBy(KEY, "ion").agg(
        F.count_if(F.col("status") == "observed").alias("observed"), F.count_if(F.col("status") != "not_visible").alias("expected")
    )


def longest_ladder(matches: DataFrame, ion: str, tol: int, max_skip: int) -> DataFrame:
    """Longest run of observed cuts whose steps fit the residues, allowing skipped cuts.

    A step fits when the mass errors of its ends differ by at most half the tolerance. The
    window covers the cuts of one peptide.
    """
    w = W.partitionBy(KEY).orderBy("cut")
    seen = matches.filter((F.col("ion") == ion) & (F.col("status") == "observed")).select(KEY, "cut", "err_u")
    fits = (F.col("cut") - F.lag("cut").over(w) <= max_skip + 1) & (F.abs(F.col("err_u") - F.lag("err_u").over(w)) <= tol // 2)
    runs = seen.withColumn("start", F.when(fits, 0).otherwise(1)).withColumn("run", F.sum("start").over(w))
    return runs.groupBy(KEY, "run").agg(F.count(F.lit(1)).alias("n")).groupBy(KEY).agg(F.max("n").alias("longest"))


def class_weights(spectra: DataFrame, size_class: Column, max_charge: int, min_total: int = 1000) -> DataFrame:
    """Share of each charge inside its size class; small classes keep weight one."""
    counts = spectra.groupBy(size_class.alias("size_class"), "charge").agg(F.count(F.lit(1)).alias("n"))
    # one row per (class, charge)
    total = F.sum("n").over(W.partitionBy("size_class"))
    share = F.col("n") / F.col("total")
    least = 0.2 / max_charge
    weight = (
        F.when(F.col("total") < min_total, 1.0)
        .when((share > 0.0005) & (share < least), least)
        .otherwise(share)
    )
    return counts.withColumn("total", total).select("size_class", "charge", weight.alias("weight"))


# Shifts of the complement sum for background statistics, in Da.
BACKGROUND_SHIFTS = (-22.0, -10.0, -8.5, 8.5, 12.0, 22.5)


def background_stats(peaks: DataFrame, sums: DataFrame, tol: int, variants: Sequence[str]) -> DataFrame:
    """Mean pair count and intensity over shifted sums, with a wider tolerance."""
    shifts = [int(s * mass.UNIT) for s in BACKGROUND_SHIFTS]
    found = complement_totals(peaks, sums, tol * 3 // 2, variants, shifts)
    return found.select(KEY, "variant", (F.col("n_pairs") / len(shifts)).alias("mean_pairs"), (F.col("total") / len(shifts)).alias("mean_intensity"))


def scan_pm_grid(peaks: DataFrame, sums: DataFrame, tol: int, step: int, half: int) -> DataFrame:
    """Pair statistics over a grid of candidate sums around the measured one.

    Pairs are found once with the whole reach; each then counts at the grid points whose
    tolerance holds it, so the band join does not run per grid point.
    """
    pairs = complement_pairs(peaks, sums, tol + step * half, ["single"])
    lo = F.greatest(F.ceil((F.col("err_u") - tol) / step), F.lit(-half)).cast("bigint")
    hi = F.least(F.floor((F.col("err_u") + tol) / step), F.lit(half)).cast("bigint")
    at = (
        pairs.withColumn("lo", lo)
        .withColumn("hi", hi)
        .filter("lo <= hi")
        .select(KEY, "err_u", F.explode(F.sequence("lo", "hi")).alias("grid"))
    )
    stats = at.groupBy(KEY, "grid").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.abs(F.col("err_u") - F.col("grid") * step)).alias("err_sum")
    )
    mean_err = F.col("err_sum") / F.col("n_pairs")
    best = stats.groupBy(KEY).agg(
        F.max("n_pairs").alias("max_pairs"), F.min(F.struct((-F.col("n_pairs")).alias("neg"), mean_err.alias("e"), "grid")).alias("b")
    )
    return stats.join(best, KEY).select(
        KEY,
        "grid",
        "n_pairs",
        mean_err.alias("mean_err"),
        "max_pairs",
        (F.col("grid") == F.col("b.grid")).alias("is_best"),
        F.log(1 + F.abs(F.col("grid") - F.col("b.grid"))).alias("log_dist"),
    )


# Fixed values.
TOP_CUTOFFS = (1, 3, 5, 10, 25, 50, 100, 250, 500)


def benchmark_topk(first_correct: DataFrame, by: str) -> DataFrame:
    """Share of spectra whose first correct answer ranks within each cutoff, by a class and overall.

    ``first_correct``: one row per spectrum with ``rank`` (NULL when none) and the class.
    """
    cols = [F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"top{k}") for k in TOP_CUTOFFS]
    return first_correct.rollup(by).agg(F.count(F.lit(1)).alias("n"), *cols)


def benchmark_precursor(candidates: DataFrame, tol: int, min_spectra: int) -> DataFrame:
    """Share correct at each candidate position and share with a wrong charge, by charge and size.

    ``candidates``: spectrum_id, charge, size_class, idx, cand_u, truth_u, wrong_charge.
    """
    ok = (F.abs(F.col("cand_u") - F.col("truth_u")) <= tol).cast("int")
    return (
        candidates.groupBy("charge", "size_class", "idx")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("share_correct"), F.avg(F.col("wrong_charge").cast("int")).alias("share_wrong_charge"))
        .filter(F.col("n") >= min_spectra)
    )


def score_normaliser(nodes: DataFrame, grid: Sequence[int], mid: float = 0.96, edge: float = 0.94) -> DataFrame:
    """Per region the shift of the score at which the share of positive true nodes is nearest its goal.

    Nodes collapse to score levels before the grid is laid over them. ``nodes``: region, score, is_true.
    """
    levels = nodes.filter("is_true").groupBy("region", "score").agg(F.count(F.lit(1)).alias("n"))
    laid = levels.withColumn("delta", F.explode(F.array(*[F.lit(g) for g in grid])))
    share = laid.groupBy("region", "delta").agg(
        (F.sum(F.when(F.col("score") + F.col("delta") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("share")
    )
    goal = F.when(F.col("region") == 1, mid).otherwise(edge)
    best = F.min(F.struct(F.round(F.abs(F.col("share") - goal), 9).alias("d"), "delta", "share")).alias("b")
    return share.groupBy("region").agg(best).select("region", F.col("b.delta").alias("delta"), F.col("b.share").alias("share"))


def normalise_scores(nodes: DataFrame, norms: DataFrame) -> DataFrame:
    """Drop below -norm, keep above norm, else move halfway to the norm. ``norms``: region, norm."""
    joined = nodes.join(norms, "region")
    return joined.filter(F.col("score") >= -F.col("norm")).withColumn(
        "norm_score", F.when(F.col("score") > F.col("norm"), F.col("score").cast("double")).otherwise((F.col("score") + F.col("norm")) / 2)
    )


LENGTH_GROUPS = ((4, 5), (6, 7), (8, 11), (12, 15), (16, 19), (20, 23))


def length_group(n: Column) -> Column:
    expr = F.lit(None).cast("string")
    for lo, hi in reversed(LENGTH_GROUPS):
        expr = F.when(n.between(lo, hi), f"{lo}-{hi}").otherwise(expr)
    return expr


def cut_context(df: DataFrame) -> DataFrame:
    """Residues next to the cut, the peptide's length group and where the cut lies."""
    n = F.length("peptide")
    place = F.when(F.col("cut") <= 2, "n_term").when(n - F.col("cut") <= 2, "c_term").otherwise("centre")
    return (
        df.withColumn("prev_res", F.substring("peptide", F.col("cut"), F.lit(1)))
        .withColumn("next_res", F.substring("peptide", F.col("cut") + 1, F.lit(1)))
        .withColumn("len_group", length_group(n))
        .withColumn("place", place)
    )


def fragment_summary(ranked: DataFrame) -> DataFrame:
    """Mean relative rank and count by the residues at the cut, per form, length group and mobility.

    Cuts next to proline also count in the form ``proline``. ``ranked``: matches with
    ``rel_rank`` and ``mobility``.
    """
    ctx = cut_context(ranked).filter(F.col("len_group").isNotNull())
    near_p = (F.col("prev_res") == "P") | (F.col("next_res") == "P")
    forms = F.when(near_p, F.array("place", F.lit("proline"))).otherwise(F.array("place"))
    return (
        ctx.withColumn("form", F.explode(forms))
        .groupBy("form", "len_group", "mobility", "prev_res", "next_res")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("rel_rank").alias("mean_rel_rank"))
    )


def relative_rank_by_residue(ranked: DataFrame, min_rows: int = 7) -> DataFrame:
    """Mean relative rank per residue, its distance from the cut and the mobility.

    Sums and counts are averaged once, so contexts weigh by their rows.
    """
    n = F.length("peptide")
    around = F.filter(F.sequence(F.lit(-2), F.lit(2)), lambda d: (F.col("cut") + d >= 1) & (F.col("cut") + d <= n))
    rows = ranked.select("peptide", "cut", "mobility", "rel_rank", F.explode(around).alias("distance"))
    rows = rows.withColumn("residue", F.substring("peptide", F.col("cut") + F.col("distance"), F.lit(1)))
    return (
        rows.groupBy("residue", "mobility", "distance")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("rel_rank").alias("mean_rel_rank"))
        .filter(F.col("n") >= min_rows)
    )


# --- probability tables ---------------------------------------------------------------


def context_counts(df: DataFrame, first: str, others: Sequence[str]) -> DataFrame:
    """Counts of each value and context, stored: a table that is as small as its contexts and may be used several times."""
    return cut_lineage(df.groupBy(first, *others).agg(F.count(F.lit(1)).alias("n")))


def conditional_probabilities(df: DataFrame, first: str, others: Sequence[str], count: Column | None = None) -> DataFrame:
    """P(first | others) from counts; the sum runs over the table of contexts. ``count``: of rows that stand for several."""
    counts = df.groupBy(first, *others).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*others)))


def weighted_kl(fine: DataFrame, coarse: DataFrame, first: str, fine_keys: Sequence[str], coarse_keys: Sequence[str]) -> DataFrame:
    """Count-weighted mean divergence of the fine table from the coarse one, per coarse context."""
    q = coarse.select(first, *coarse_keys, F.col("p").alias("q"))
    joined = fine.join(q, [first, *coarse_keys])
    # every fine context contributes n_context * sum p ln(p/q) = sum n ln(p/q)
    return joined.groupBy(*coarse_keys).agg(
        (F.sum(F.col("n") * F.log(F.col("p") / F.col("q"))) / F.sum("n")).alias("kl")
    )


def log_odds(table: DataFrame, random: DataFrame, first: str) -> DataFrame:
    r = random.select(first, F.col("p").alias("random_p"))
    return table.join(r, first).withColumn("log_odds", F.log(F.col("p") / F.col("random_p")))


# Fixed values.
RANK_LEVELS = (1, 2, 3, 5, 7, 10, 15, 20, 30, 55)


def rank_level(rank: Column) -> Column:
    expr = F.lit(len(RANK_LEVELS))
    for i in range(len(RANK_LEVELS) - 1, -1, -1):
        expr = F.when(rank <= RANK_LEVELS[i], F.lit(i)).otherwise(expr)
    return expr.cast("int")


def ion_rank_histogram(ranked: DataFrame, ions: Sequence[str]) -> DataFrame:
    """Peaks per rank level and ion; unexplained peaks count as ``none``. ``ranked``: rank, ion."""
    return ranked.groupBy(rank_level(F.col("rank")).alias("level")).agg(
        *[F.count_if(F.col("ion") == i).alias(i) for i in ions],
        F.count_if(F.col("ion").isNull()).alias("none"),
        F.count(F.lit(1)).alias("total"),
    )


def ion_pairs(observed: DataFrame) -> DataFrame:
    """Counts of ion pairs seen at one cut. A cut has at most one row per ion, so the pairs of a
    cut are bounded by the ion table."""
    sets = observed.groupBy(KEY, "cut").agg(F.sort_array(F.collect_set("ion")).alias("ions")).filter(F.size("ions") >= 2)
    pairs = F.flatten(
        F.transform(
            "ions",
            lambda x, i: F.transform(
                F.filter("ions", lambda y: y > x), lambda y: F.struct(x.alias("ion_a"), y.alias("ion_b"))
            ),
        )
    )
    return sets.select(F.inline(pairs)).groupBy("ion_a", "ion_b").agg(F.count(F.lit(1)).alias("n"))


def cover_pairs(observed: DataFrame, classes: Sequence[str], strong: Sequence[str], rounds: int = 6, with_strong: bool = True) -> DataFrame:
    """(classes, round, ion_a, ion_b, n): greedy pairs of ions that cover the cuts of each class.

    Each round takes in every class the pair met at most cuts that are not covered yet, ties by name. A
    cut is covered by a ``strong`` ion on a strong peak or by both ions of a chosen pair; cuts with one ion
    do not count. ``with_strong``: one ion of a pair must be a strong one, and comes first. All classes
    go on at once in one table of ion sets with counts, bounded by classes and sets of the ion table.
    ``observed``: spectrum_id, cut, classes, ion, strong_peak; an ion once a cut.
    """
    classes = list(classes)
    is_strong = F.col("ion").isin(*strong)
    sets = observed.groupBy(KEY, "cut", *classes).agg(F.sort_array(F.collect_set("ion")).alias("ions"), F.bool_or(is_strong & F.col("strong_peak")).alias("covered"))
    left = cut_lineage(sets.filter((F.size("ions") >= 2) & ~F.col("covered")).groupBy(*classes, "ions").agg(F.count(F.lit(1)).alias("n")))
    strong_list = F.array(*[F.lit(i) for i in strong])
    fits = lambda x, y: F.array_contains(strong_list, x) | F.array_contains(strong_list, y) if with_strong else F.lit(True)
    pairs = F.flatten(F.transform("ions", lambda x: F.transform(F.filter("ions", lambda y: (y > x) & fits(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    chosen = []
    for number in range(rounds):
        counts = left.select(*classes, "n", F.inline(pairs)).groupBy(*classes, "a", "b").agg(F.sum("n").alias("n"))
        first = F.min(F.struct((-F.col("n")).alias("less"), "a", "b")).alias("p")
        best = cut_lineage(counts.groupBy(*classes).agg(first).select(*classes, "p.*"))
        if best.isEmpty():
            break
        chosen.append(best.withColumn("round", F.lit(number)))
        met = left.join(best.select(*classes, "a", "b"), classes, "left") if classes else left.crossJoin(F.broadcast(best.select("a", "b")))
        left = cut_lineage(met.filter(F.col("a").isNull() | ~(F.array_contains("ions", F.col("a")) & F.array_contains("ions", F.col("b")))).select(*left.columns))
    if not chosen:
        return left.select(*classes, F.lit(0).alias("round"), F.lit("").alias("ion_a"), F.lit("").alias("ion_b"), "n").limit(0)
    swap = F.lit(with_strong) & ~F.array_contains(strong_list, F.col("a"))
    rows = reduce(DataFrame.unionByName, chosen)
    return rows.select(
        *classes, "round", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("ion_a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("ion_b"), (-F.col("less")).alias("n")
    )


def calibration_histogram(scored: DataFrame, label: str, prob: Column, bins: int = 20) -> DataFrame:
    """Probability bins with the cumulative share of each class."""
    slot = F.least(F.floor(prob * bins), F.lit(bins - 1)).cast("int")
    counts = scored.groupBy(F.col(label).alias("label"), slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # at most bins rows per class
    up = W.partitionBy("label").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return counts.select("label", "bin", "n", (F.sum("n").over(up) / F.sum("n").over(W.partitionBy("label"))).alias("cum_share"))
