"""Statistical learning data work."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from peakloom.operators import learning as ml
from peakloom.plans.registry import query
from peakloom.plans.stat_plans import MOB, OBSERVED, mobile, rounded
from peakloom.plans.text_plans import PATHS, scored_paths

ID = "spectrum_id"
INPUTS = ["log_chars", "is_en", "toxic"]


def documents_for_model(t):
    return t.labelled().select(
        "doc_id",
        F.col("quality").cast("double").alias("quality"),
        F.log("n_chars").alias("log_chars"),
        (F.col("lang") == "en").cast("double").alias("is_en"),
        F.col("toxic").cast("double").alias("toxic"),
        F.when(F.col("n_chars") < 1500, "short").otherwise("long").alias("size"),
        (F.lit(1.0) + F.col("toxic")).alias("weight"),
    )


MODEL_ROWS = """SELECT doc_id, quality, ln(n_chars) AS log_chars, CAST(lang = 'en' AS DOUBLE) AS is_en, CAST(toxic AS DOUBLE) AS toxic,
    CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END AS size, 1.0 + toxic AS weight FROM labelled"""


@query("ML1", f"SELECT size, count(*) AS n_rows, round(sum(weight*quality)/sum(weight), 3) AS mean_label, round(sum(weight*quality)/sum(weight), 3) AS mean_fitted FROM ({MODEL_ROWS}) GROUP BY 1")
def ml1(t):
    """With a free intercept the fitted probabilities of a class have the mean of its labels."""
    rows = documents_for_model(t)
    models = ml.fit_probability(rows, INPUTS, "quality", "weight", ["size"])
    scored = ml.predict_probability(rows, models, INPUTS, ["size"], 0.0, 1.0)
    mean = lambda c: F.round(F.sum(F.col("weight") * F.col(c)) / F.sum("weight"), 3)
    return scored.groupBy("size").agg(F.count(F.lit(1)).alias("n_rows"), mean("quality").alias("mean_label"), mean("prob").alias("mean_fitted"))


#: Given models of both sizes: coefficients of INPUTS and the intercept.
GIVEN = {("short",): SimpleNamespace(coefficients=(0.25, -0.5, -1.25), intercept=0.5), ("long",): SimpleNamespace(coefficients=(-0.125, 0.75, -0.5), intercept=1.5)}
_LINEAR = "CASE size " + " ".join(f"WHEN '{k[0]}' THEN {m.intercept} + " + " + ".join(f"{n}*({w})" for n, w in zip(INPUTS, m.coefficients)) for k, m in GIVEN.items()) + " END"


@query("ML2", f"SELECT doc_id, size, round(p, 6) AS prob, round(greatest((p - 0.05)*1.1, 0.0), 6) AS corrected FROM (SELECT doc_id, size, 1/(1 + exp(-({_LINEAR}))) AS p FROM ({MODEL_ROWS}))")
def ml2(t):
    out = ml.predict_probability(documents_for_model(t), GIVEN, INPUTS, ["size"], -0.05, 1.1)
    return rounded(out.select("doc_id", "size", "prob", "corrected"), "prob", "corrected")


@query("ML3", """SELECT spectrum_id, a.charge, round(min(CASE WHEN b.prob IS NULL THEN NULL WHEN a.prob + b.prob > 0 THEN a.prob/(a.prob + b.prob) ELSE 0.5 END), 6) AS min_prob FROM quality a LEFT JOIN quality b USING (spectrum_id) WHERE b.charge <> a.charge OR (SELECT count(*) FROM quality q WHERE q.spectrum_id = a.spectrum_id) = 1 GROUP BY 1, 2""")
def ml3(t):
    return rounded(ml.charge_comparison(t.quality()), "min_prob")


@query("ML4", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY prob DESC, charge) AS rn FROM quality)
    SELECT a.spectrum_id, a.charge AS best, b.charge AS second, a.prob - b.prob AS gap FROM r a LEFT JOIN r b ON b.spectrum_id = a.spectrum_id AND b.rn = 2 WHERE a.rn = 1""")
def ml4(t):
    return ml.best_charge(t.quality())


def items(t):
    return t.ion_matches(observed=True).select(ID, "ion", "cut", "intensity", (-F.abs("err_u")).alias("score"))


ITEMS = f"SELECT spectrum_id, ion, cut, intensity, -abs(err_u) AS score FROM ion_matches WHERE {OBSERVED}"
PREF = f"""SELECT a.spectrum_id, a.ion AS ion_hi, a.cut AS cut_hi, b.ion AS ion_lo, b.cut AS cut_lo, least(1.0, (6*(a.intensity - b.intensity) + 4*a.intensity)/(10*top)) AS weight, 6*(a.intensity - b.intensity) + 4*a.intensity AS points, a.score <= b.score AS wrong
    FROM ({ITEMS}) a JOIN ({ITEMS}) b USING (spectrum_id) JOIN (SELECT spectrum_id, max(intensity) AS top FROM ({ITEMS}) GROUP BY 1) USING (spectrum_id) WHERE a.intensity > b.intensity AND b.intensity*100 <= a.intensity*85
    AND 6*(a.intensity - b.intensity) + 4*a.intensity >= (CASE WHEN b.intensity = 0 THEN 2.5 ELSE 1 END)*top"""


def pairs(t):
    return ml.preference_pairs(items(t), ID, ["ion", "cut"])


@query("ML5", f"SELECT spectrum_id, ion_hi, cut_hi, ion_lo, cut_lo, round(weight, 6) AS weight, wrong FROM ({PREF})")
def ml5(t):
    return rounded(pairs(t).drop("points"), "weight")


@query("ML6", f"SELECT spectrum_id, round(sum(CASE WHEN wrong THEN points ELSE 0 END)/sum(points), 6) AS error FROM ({PREF}) GROUP BY 1")
def ml6(t):
    return rounded(ml.pairwise_rank_error(pairs(t), ID), "error")


LIMITS = """SELECT feature, CAST(i AS INTEGER) AS pick, value AS lim FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn, count(*) OVER (PARTITION BY feature) AS total FROM features), range(1, 10) AS r(i) WHERE total >= 100 AND rn = greatest(total*i//10, 1)"""


@query("ML7", f'SELECT feature, pick, lim AS "limit" FROM ({LIMITS})')
def ml7(t):
    return ml.feature_bins(t.features(), 10, 100)


@query("ML8", f"""WITH l AS ({LIMITS}) SELECT sample_id, round(CAST(sum(CASE WHEN value <> 0 THEN CASE feature WHEN 'high' THEN 0.5 WHEN 'click' THEN -0.25 ELSE 0.0 END ELSE 0.0 END + n*0.1) - 1.5 AS DOUBLE), 6) AS score FROM (
    SELECT f.sample_id, f.feature, f.value, count(*) FILTER (WHERE f.value > l.lim) AS n FROM features f LEFT JOIN l USING (feature) GROUP BY 1, 2, 3) GROUP BY 1""")
def ml8(t):
    return rounded(ml.additive_score(t.features(), ml.feature_bins(t.features(), 10, 100), {"high": 0.5, "click": -0.25}, 0.1, 1.5), "score")


@query("ML9", """SELECT feature, count(*) FILTER (WHERE value = 0) AS n_zero, count(*) FILTER (WHERE value <> 0) AS n_active, count(DISTINCT value) AS n_values, min(value) AS min_value, max(value) AS max_value FROM features GROUP BY 1""")
def ml9(t):
    return ml.feature_summary(t.features())


@query("ML10", """SELECT feature, CAST(sum(CASE WHEN label = 1 THEN 4 ELSE -1 END) AS BIGINT) AS potential FROM features WHERE value <> 0 GROUP BY 1 ORDER BY abs(sum(CASE WHEN label = 1 THEN 4 ELSE -1 END)) DESC, feature LIMIT 1""")
def ml10(t):
    return ml.best_weak_feature(t.features(), F.when(F.col("label") == 1, 4).otherwise(-1))


@query("ML11", f"""SELECT *, n_train >= 100 AS enough FROM (SELECT mobility, size, count(*) FILTER (WHERE h < '4000') AS n_test, count(*) FILTER (WHERE h >= '4000') AS n_train FROM (
    SELECT mobility, CAST(pm_u // 10000000 AS BIGINT) AS size, substr(md5(concat_ws(':', spectrum_id, 3)), 1, 4) AS h FROM ({MOB})) GROUP BY 1, 2)""")
def ml11(t):
    rows = mobile(t).withColumn("size", F.floor(F.col("pm_u") / 10_000_000).cast("bigint"))
    return ml.train_partitions(rows, ["mobility", "size"], ID, "4000", 100, 3)


@query("ML12", """WITH w AS (SELECT spectrum_id, seq, charge, score, 1 - score/5100 AS w FROM solutions) SELECT spectrum_id, seq, charge, score, round(w*CASE charge WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END*(count(*) OVER ())/(sum(w) OVER (PARTITION BY charge)), 6) AS weight FROM w""")
def ml12(t):
    out = ml.negative_weights(t.solutions(), "charge", F.col("score") / 5100, {1: 0.5, 2: 0.3, 3: 0.2})
    return rounded(out.select(ID, "seq", "charge", "score", "weight"), "weight")


@query("ML13", f"""SELECT spectrum_id, round(list_sum(p)/len(p), 6) AS mean_prob, s[1] AS lowest, s[2] AS second_lowest FROM (SELECT *, list_sort(p) AS s FROM (
    SELECT spectrum_id, list_transform(range(1, length(path) + 2), lambda i: ((ascii(substr('B' || path, i, 1))*37 + (i - 1)*11) % 100)/100) AS p FROM ({PATHS})))""")
def ml13(t):
    return rounded(scored_paths(t).select(ID, *ml.path_probability_features(F.col("probs"))), "mean_prob")


@query("ML14", """SELECT spectrum_id, ion, cut, expected_u, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, ion, cut) AS rank FROM (
    SELECT spectrum_id, ion, cut, expected_u, CASE WHEN strong THEN 40 ELSE 0 END + CASE WHEN orientation = 'suffix' THEN 5 ELSE 0 END - abs(2*cut - length(peptide)) + CASE WHEN substr(peptide, cut + 1, 1) = 'P' THEN 20 ELSE 0 END AS score FROM expected)) WHERE rank <= 10""")
def ml14(t):
    score = (
        F.when(F.col("strong"), 40).otherwise(0)
        + F.when(F.col("orientation") == "suffix", 5).otherwise(0)
        - F.abs(2 * F.col("cut") - F.length("peptide"))
        + F.when(F.substring("peptide", F.col("cut") + 1, F.lit(1)) == "P", 20).otherwise(0)
    )
    out = ml.predicted_peaks(t.expected(), score.cast("bigint"), 10)
    return out.select(ID, "ion", "cut", "expected_u", "score", "rank")


@query("ML15", "SELECT sample_id, label, substr(md5(concat_ws(':', grp, 5)), 1, 4) < '3333' AS is_test FROM samples")
def ml15(t):
    train, test = ml.split_set(t.samples().select("sample_id", "label", "grp"), "grp", "3333", 5)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True))).drop("grp")


@query("ML16", "SELECT sample_id, label, round(weight*CASE WHEN label = 0 THEN 0.4 ELSE 0.6 END*1000/(sum(weight) OVER (PARTITION BY label)), 6) AS weight FROM weighted")
def ml16(t):
    return rounded(ml.calibrate_class_weights(t.weighted(), 0.4, 1000.0), "weight").select("sample_id", "label", "weight")


@query("ML17", """SELECT sample_id, label, feature, value FROM features WHERE feature NOT IN (SELECT feature FROM features GROUP BY 1 HAVING count(*) FILTER (WHERE value <> 0) > 0
    AND (count(*) FILTER (WHERE value <> 0 AND label = 0) < 150 OR count(*) FILTER (WHERE value <> 0 AND label = 1) < 150))""")
def ml17(t):
    return ml.purge_rare_features(t.features(), 150, [0, 1]).select("sample_id", "label", "feature", "value")


@query("ML18", """WITH f AS (SELECT w.*, h.sample_id IS NOT NULL AS has FROM weighted w LEFT JOIN (SELECT DISTINCT sample_id FROM features WHERE feature = 'high' AND value <> 0) h USING (sample_id)),
    s AS (SELECT greatest(0.2, least(5.0, sum(weight) FILTER (WHERE label = 1 AND NOT has)*0.25/(sum(weight) FILTER (WHERE label = 1 AND has)*0.75))) AS factor FROM f)
    SELECT sample_id, label, round(CASE WHEN label = 1 AND has THEN weight*factor ELSE weight END, 6) AS weight FROM f, s""")
def ml18(t):
    holders = t.features().filter("feature = 'high' and value <> 0")
    return rounded(ml.match_feature_share(t.weighted(), holders, 1, 0.25), "weight")


@query("ML19", """SELECT feature, f.label, round(sum(CASE WHEN value = 0 THEN weight ELSE 0 END)/sum(weight), 6) AS zero_share, round(sum(value*weight)/sum(weight), 6) AS mean_value, count(*) AS n FROM features f JOIN weighted USING (sample_id) GROUP BY 1, 2""")
def ml19(t):
    return rounded(ml.feature_statistics(t.features(), t.weighted()), "zero_share", "mean_value")


@query("ML20", f"SELECT spectrum_id, ion_hi, cut_hi, ion_lo, cut_lo, round(weight, 6) AS weight FROM ({PREF}) WHERE wrong ORDER BY round(weight, 9) DESC, spectrum_id, ion_hi, cut_hi, ion_lo, cut_lo LIMIT 200")
def ml20(t):
    order = [F.col(c) for c in (ID, "ion_hi", "cut_hi", "ion_lo", "cut_lo")]
    return rounded(ml.misordered_pairs(pairs(t), 200, order).drop("wrong", "points"), "weight")


@query("ML21", f"""SELECT CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(p), 6) AS mean_rank, round(stddev_pop(p), 6) AS sd_rank FROM (SELECT row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, ion, cut) AS k,
    row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, ion, cut) AS p FROM ({ITEMS})) WHERE k <= 5 GROUP BY 1""")
def ml21(t):
    return rounded(ml.rank_error_report(items(t), ID, ["ion", "cut"], 5), "mean_rank", "sd_rank")


@query("ML22", """WITH p AS (SELECT s.spectrum_id, a.mass_u + b.mass_u - s.sum_u AS err_u FROM sums s JOIN peaks a ON a.spectrum_id = s.spectrum_id JOIN peaks b ON b.spectrum_id = s.spectrum_id
      WHERE a.mass_u < b.mass_u AND abs(a.mass_u + b.mass_u - s.sum_u) <= 50000),
    x AS (SELECT spectrum_id, err_u, unnest(range(-20, 21)) AS grid FROM p), g AS (SELECT DISTINCT spectrum_id, grid FROM x WHERE abs(err_u - grid*1000) <= 30000),
    b AS (SELECT spectrum_id, grid AS positive FROM (SELECT g.*, row_number() OVER (PARTITION BY g.spectrum_id ORDER BY abs(grid*1000 - (coalesce(sqs, 0) - 500)*20), grid) AS rn FROM g JOIN spectra USING (spectrum_id)) WHERE rn = 1)
    SELECT spectrum_id, grid, CAST(grid = positive AS INTEGER) AS label FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY md5(spectrum_id || ':' || grid), grid) AS lot FROM g) JOIN b USING (spectrum_id)
    WHERE abs(grid - positive) IN (0, 4, 5, 7, 9, 10, 15, 19, 20) OR (lot <= 5 AND abs(grid - positive) >= 6)""")
def ml22(t):
    from peakloom.operators.stats import scan_pm_grid

    grid = scan_pm_grid(t.peak_list(), t.sums(), 30_000, 1_000, 20).select(ID, "grid")
    truth = t.spectra().select(ID, ((F.coalesce("sqs", F.lit(0)) - 500) * 20).alias("truth_u"))
    return ml.grid_negatives(grid, truth, 1_000)


@query("ML23", """WITH c AS (SELECT file_idx, spectrum_id AS scan, replace(seq, 'I', 'L') AS seq, max(score) AS score FROM solutions JOIN spectra USING (spectrum_id) GROUP BY 1, 2, 3)
    SELECT file_idx, scan, replace(peptide, 'I', 'L') AS positive, seq, score FROM annotated a JOIN c USING (file_idx) WHERE a.spectrum_id = c.scan AND seq <> replace(peptide, 'I', 'L')""")
def ml23(t):
    keys = t.spectra().select(ID, "file_idx")
    cands = t.solutions().select(ID, "seq", "score").join(keys, ID).withColumnRenamed(ID, "scan")
    return ml.candidate_sets(t.annotated().select("file_idx", F.col(ID).alias("scan"), "peptide"), cands)


@query("ML24", f"SELECT spectrum_id, peptide FROM ({MOB}) m JOIN (SELECT spectrum_id, charge FROM spectra) USING (spectrum_id) WHERE charge = 2 AND mobility = 'mobile' AND length(peptide) BETWEEN 5 AND 8 AND pm_u BETWEEN 18000000 AND 19500000")
def ml24(t):
    return ml.select_examples(mobile(t), 2, "mobile", (5, 8), (18_000_000, 19_500_000)).select(ID, "peptide")


@query("ML25", """SELECT sample_id, label, weight FROM weighted WHERE NOT (label = 1 AND substr(md5(concat_ws(':', sample_id, 11)), 1, 4) < '8000' AND sample_id IN (SELECT sample_id FROM features WHERE feature = 'high' AND value <> 0))""")
def ml25(t):
    return ml.down_sample(t.features(), t.weighted(), 1, "high", "8000", 11)
