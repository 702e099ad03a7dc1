"""Aggregates and reports."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from peakloom.functions import mass
from peakloom.operators import fdr, keyed, peaks as pk, peptide as pep, selection as sel, stats as st
from peakloom.plans.bindings import EDGE_TOL, ION_TOL
from peakloom.plans.hit_plans import levels
from peakloom.plans.peak_plans import CLASSES, pairs_sql
from peakloom.plans.registry import query
from peakloom.plans.text_plans import MOBILITY

ID = "spectrum_id"
OBSERVED = "status = 'observed'"
SIZE_SQL = "CAST(CASE WHEN pm_u < 9500000 THEN 0 WHEN pm_u < 18500000 THEN 1 WHEN pm_u < 28000000 THEN 2 ELSE 3 END AS INTEGER)"


def rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def mobile(t):
    return t.annotated().select(ID, "peptide", "charge", "pm_u", F.length("peptide").alias("len"), pep.proton_mobility(F.col("peptide"), F.col("charge")).alias("mobility"))


ERRORS = """SELECT s.charge, abs(s.mz_u - (p.total_u + 190184 + (s.charge - 1)*10073)//s.charge) AS err FROM annotated s JOIN (SELECT spectrum_id, CAST(sum(mass) AS BIGINT) AS total_u FROM peptide_residues GROUP BY 1) p USING (spectrum_id)"""


@query("AGG4", f"SELECT charge, err AS tol_u, n FROM (SELECT *, row_number() OVER (PARTITION BY charge ORDER BY err) AS rn, count(*) OVER (PARTITION BY charge) AS n FROM ({ERRORS})) WHERE rn = n - n*5//100")
def agg4(t):
    theo = mass.precursor_mz(mass.peptide_mass(F.col("peptide")) + mass.WATER_PROTON, F.col("charge"))
    return st.error_cutoff(t.annotated().select("charge", (F.col("mz_u") - theo).alias("err")), ["charge"], F.col("err"), 95)


TOP_IONS = f"SELECT ion FROM ion_matches WHERE {OBSERVED} GROUP BY 1 ORDER BY sum(intensity) DESC, ion LIMIT 2"


@query("AGG5", f"""SELECT ion, err AS tol_u, n FROM (SELECT ion, abs(err_u) AS err, row_number() OVER (PARTITION BY ion ORDER BY abs(err_u)) AS rn, count(*) OVER (PARTITION BY ion) AS n FROM ion_matches
    WHERE {OBSERVED} AND ion IN ({TOP_IONS})) WHERE rn = n - n*10//100""")
def agg5(t):
    return st.fragment_tolerance(t.ion_matches(observed=True), 90)


@query("AGG37", f"SELECT ion, CAST(greatest(least(round(err_u/1500), 20), -20) AS INTEGER) AS bin, count(*) AS n FROM ion_matches WHERE {OBSERVED} GROUP BY 1, 2")
def agg37(t):
    return st.mass_error_bins(t.ion_matches(), 1_500)


ISOTOPES = "SELECT DISTINCT p.spectrum_id, p.mass_u FROM peaks p JOIN peaks q ON q.spectrum_id = p.spectrum_id AND p.mass_u - q.mass_u BETWEEN 7533 AND 12533"
OFFSETS = """SELECT c.spectrum_id, c.cut, c.orientation, p.mass_u, p.mass_u - at_u AS offset_u FROM (SELECT spectrum_id, cut, 'prefix' AS orientation, cut_u AS at_u FROM cuts UNION ALL SELECT spectrum_id, cut, 'suffix', total_u - cut_u FROM cuts) c
    JOIN {src} p ON p.spectrum_id = c.spectrum_id AND p.mass_u BETWEEN at_u - 600000 AND at_u + 600000"""
HIST = """SELECT orientation, bin + d AS bin, CAST(sum(n*k) AS BIGINT) AS weight FROM (SELECT orientation, CAST(floor(offset_u/10000) AS BIGINT) AS bin, count(*) AS n FROM ({off}) GROUP BY 1, 2)
    CROSS JOIN (VALUES (-4, 2), (-3, 4), (-2, 6), (-1, 9), (0, 10), (1, 9), (2, 6), (3, 4), (4, 2)) AS v(d, k) GROUP BY 1, 2"""
PLAIN = f"(SELECT * FROM peaks ANTI JOIN ({ISOTOPES}) USING (spectrum_id, mass_u))"
HIST6 = HIST.format(off=OFFSETS.format(src=PLAIN))


def plain_peaks(t):
    return t.peak_list().join(pk.possible_isotopes(t.peak_list(), 5_000), [ID, "mass_u"], "left_anti")


def hist6(t):
    return st.offset_histogram(st.peak_offsets(t.cuts(), plain_peaks(t), 600_000), 10_000)


@query("AGG6", HIST6)
def agg6(t):
    return hist6(t)


UNEXPLAINED = f"(SELECT * FROM peaks ANTI JOIN (SELECT spectrum_id, mass_u FROM ion_matches WHERE {OBSERVED}) USING (spectrum_id, mass_u))"


@query("AGG7", HIST.format(off=OFFSETS.format(src=UNEXPLAINED)))
def agg7(t):
    used = t.ion_matches(observed=True).select(ID, "mass_u")
    free = t.peak_list().join(used, [ID, "mass_u"], "left_anti")
    return st.offset_histogram(st.peak_offsets(t.cuts(), free, 600_000), 10_000)


@query("AGG8", f"""WITH h AS ({HIST6}), m AS (SELECT a.* FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.orientation = a.orientation AND abs(b.bin - a.bin) <= 5 AND (b.weight > a.weight OR (b.weight = a.weight AND b.bin < a.bin))))
    SELECT orientation, bin, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY orientation ORDER BY weight DESC, bin) AS rank FROM m) WHERE rank <= 6""")
def agg8(t):
    return st.offset_modes(hist6(t), 6, 5)


CONTEXT = f"""SELECT m.*, s.charge, {SIZE_SQL} AS size_class, CAST(CASE WHEN cut_u < pm_u*0.225 OR (s.charge <= 2 AND cut_u < lo_u + 1500000) THEN 0 WHEN cut_u > pm_u*0.775 OR (s.charge <= 2 AND cut_u > hi_u - 1500000) THEN 2 ELSE 1 END AS INTEGER) AS region
    FROM ion_matches m JOIN spectra s USING (spectrum_id) JOIN peak_range USING (spectrum_id)"""


def contexts(t):
    info = t.spectra().select(ID, "charge", "pm_u").join(pk.peak_range(t.peak_list()), ID)
    region = pk.classify_region(F.col("cut_u"), F.col("pm_u"), F.col("charge"), F.col("lo_u"), F.col("hi_u"))
    return t.ion_matches().join(info, ID).withColumn("region", region).withColumn("size_class", mass.size_class(F.col("pm_u"), CLASSES))


@query("AGG9", f"SELECT charge, size_class, region, ion, count(*) AS n_visible, round(count(*) FILTER (WHERE {OBSERVED})/count(*), 6) AS prob FROM ({CONTEXT}) WHERE status <> 'not_visible' GROUP BY 1, 2, 3, 4")
def agg9(t):
    return rounded(st.ion_probabilities(contexts(t), ["charge", "size_class", "region"]), "prob")


DETECT = f"SELECT ion, {{m}} AS mobility, count(*) FILTER (WHERE {OBSERVED}) AS observed, count(*) FILTER (WHERE status <> 'not_visible') AS total FROM ion_matches JOIN (SELECT spectrum_id, {MOBILITY} AS mobility FROM annotated) USING (spectrum_id) GROUP BY 1, 2"


@query("AGG10", DETECT.format(m="mobility") + " UNION ALL " + DETECT.format(m="'all'"))
def agg10(t):
    return st.ion_detection(t.ion_matches().join(mobile(t).select(ID, "mobility"), ID), "mobility")


KINDS = ["mobile", "partial", "non_mobile"]


def cross_sql(source: str, row: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE mobility = '{k}') AS {k}" for k in KINDS)
    shares = ", ".join(f"round(CASE WHEN max(c.{k}) OVER () > 0 THEN c.{k}/max(c.{k}) OVER () ELSE 0.0 END, 6) AS share_{k}" for k in KINDS)
    return f"""WITH b AS ({source}), c AS (SELECT CAST({row} AS VARCHAR) AS row, {counts}, count(*) AS total FROM b GROUP BY 1 UNION ALL SELECT 'all', {counts}, count(*) FROM b)
    SELECT row, {', '.join(KINDS)}, total, {shares} FROM c"""


SHARES = [f"share_{k}" for k in KINDS]
MOB = f"SELECT spectrum_id, peptide, pm_u, {MOBILITY} AS mobility FROM annotated"


@query("AGG11", cross_sql(MOB, "length(peptide)"))
def agg11(t):
    return rounded(st.cross_table(mobile(t), "len", "mobility", KINDS), *SHARES)


@query("AGG12", cross_sql(MOB, "pm_u // 1000000"))
def agg12(t):
    bucket = mobile(t).withColumn("bucket", F.floor(F.col("pm_u") / 1_000_000))
    return rounded(st.cross_table(bucket, "bucket", "mobility", KINDS), *SHARES)


@query("AGG13", cross_sql(f"SELECT mobility, residue FROM ({MOB}) JOIN peptide_residues USING (spectrum_id)", "residue"))
def agg13(t):
    letters = mobile(t).select("mobility", F.explode(F.split("peptide", "")).alias("residue"))
    return rounded(st.cross_table(letters, "residue", "mobility", KINDS), *SHARES)


@query("AGG14", f"""SELECT spectrum_id, round(coalesce(e, 0)/total, 6) AS share FROM (SELECT spectrum_id, sum(intensity) AS total FROM peaks GROUP BY 1)
    LEFT JOIN (SELECT spectrum_id, sum(intensity) AS e FROM (SELECT DISTINCT spectrum_id, mass_u, intensity FROM ion_matches WHERE {OBSERVED}) GROUP BY 1) USING (spectrum_id)""")
def agg14(t):
    return rounded(st.explained_intensity(t.ion_matches(), t.peak_list()), "share")


@query("AGG15", f"SELECT spectrum_id, ion, count(*) FILTER (WHERE {OBSERVED}) AS observed, count(*) FILTER (WHERE status <> 'not_visible') AS expected FROM ion_matches GROUP BY 1, 2")
def agg15(t):
    return st.observed_expected(t.ion_matches())


@query("AGG17", f"""WITH s AS (SELECT spectrum_id, cut, err_u, lag(cut) OVER w AS pc, lag(err_u) OVER w AS pe FROM ion_matches WHERE {OBSERVED} AND ion = 'b' WINDOW w AS (PARTITION BY spectrum_id ORDER BY cut)),
    r AS (SELECT *, sum(CASE WHEN cut - pc <= 2 AND abs(err_u - pe) <= {ION_TOL // 2} THEN 0 ELSE 1 END) OVER (PARTITION BY spectrum_id ORDER BY cut) AS run FROM s)
    SELECT spectrum_id, max(n) AS longest FROM (SELECT spectrum_id, run, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1""")
def agg17(t):
    return st.longest_ladder(t.ion_matches(), "b", ION_TOL, 1)


@query("AGG18", f"""SELECT size_class, charge, round(CASE WHEN total < 400 THEN 1.0 WHEN n/total > 0.0005 AND n/total < 0.2/3 THEN 0.2/3 ELSE n/total END, 6) AS weight FROM (
    SELECT *, sum(n) OVER (PARTITION BY size_class) AS total FROM (SELECT CAST(CASE WHEN mz_u < 9300000 THEN 0 WHEN mz_u < 9400000 THEN 1 ELSE 2 END AS INTEGER) AS size_class, charge, count(*) AS n FROM spectra GROUP BY 1, 2))""")
def agg18(t):
    return rounded(st.class_weights(t.spectra(), mass.size_class(F.col("mz_u"), [9_300_000, 9_400_000]), 3, 400), "weight")


SHIFTED = "SELECT spectrum_id, shift, sum_u + shift AS sum_u FROM sums CROSS JOIN (VALUES (-220000), (-100000), (-85000), (85000), (120000), (225000)) AS v(shift)"


@query("AGG19", f"""WITH shifted AS ({SHIFTED}), p AS ({pairs_sql(30_000, ['single', 'double'], 'shifted', 's.shift,')})
    SELECT spectrum_id, variant, round(count(*)/6, 6) AS mean_pairs, round(sum(int_a + int_b)/6, 6) AS mean_intensity FROM p GROUP BY 1, 2""")
def agg19(t):
    return rounded(st.background_stats(t.peak_list(), t.sums(), 20_000, ["single", "double"]), "mean_pairs", "mean_intensity")


@query("AGG20", """WITH p AS (SELECT s.spectrum_id, a.mass_u + b.mass_u - s.sum_u AS err_u FROM sums s JOIN peaks a ON a.spectrum_id = s.spectrum_id JOIN peaks b ON b.spectrum_id = s.spectrum_id
      WHERE a.mass_u < b.mass_u AND abs(a.mass_u + b.mass_u - s.sum_u) <= 40000),
    x AS (SELECT spectrum_id, err_u, unnest(range(-20, 21)) AS grid FROM p), g AS (SELECT spectrum_id, grid, count(*) AS n_pairs, sum(abs(err_u - grid*1000)) AS es FROM x WHERE abs(err_u - grid*1000) <= 20000 GROUP BY 1, 2),
    b AS (SELECT *, max(n_pairs) OVER (PARTITION BY spectrum_id) AS max_pairs, first_value(grid) OVER (PARTITION BY spectrum_id ORDER BY n_pairs DESC, es/n_pairs, grid) AS bg FROM g)
    SELECT spectrum_id, grid, n_pairs, round(es/n_pairs, 6) AS mean_err, max_pairs, grid = bg AS is_best, round(ln(1 + abs(grid - bg)), 6) AS log_dist FROM b""")
def agg20(t):
    return rounded(st.scan_pm_grid(t.peak_list(), t.sums(), 20_000, 1_000, 20), "mean_err", "log_dist")


@query("AGG22", """SELECT slot, n, round(n/sum(n) OVER (), 6) AS share FROM (SELECT CAST(CASE WHEN intensity >= 40 THEN 4 WHEN intensity >= 20 THEN 3 WHEN intensity >= 10 THEN 2 WHEN intensity >= 5 THEN 1 ELSE 0 END AS INTEGER) AS slot, count(*) AS n FROM peaks GROUP BY 1)""")
def agg22(t):
    return rounded(st.histogram(t.peaks(), F.col("intensity"), [5, 10, 20, 40]), "share")


@query("AGG23", """SELECT charge, n, round(sx/n, 6) AS mean, round(sqrt(greatest(sxx/n - (sx/n)*(sx/n), 0)), 6) AS sd, round(swx/sw, 6) AS wmean, round(sqrt(greatest(swxx/sw - (swx/sw)*(swx/sw), 0)), 6) AS wsd FROM (
    SELECT charge, count(*) AS n, sum(x) AS sx, sum(x*x) AS sxx, sum(w) AS sw, sum(w*x) AS swx, sum(w*x*x) AS swxx FROM (SELECT charge, mass_u//10000 AS x, intensity AS w FROM peaks JOIN spectra USING (spectrum_id)) GROUP BY 1)""")
def agg23(t):
    joined = t.peak_list().join(t.spectra().select(ID, "charge"), ID)
    out = st.mean_sd(joined, ["charge"], F.expr("mass_u div 10000"), F.col("intensity"))
    return rounded(out, "mean", "sd", "wmean", "wsd")


@query("AGG23C", """SELECT charge, round(s/n, 6) AS mean, round(sqrt(greatest(ss/n - (s/n)*(s/n), 0)), 6) AS sd FROM (SELECT charge, sum(k) AS n, sum(k*x) AS s, sum(k*x*x) AS ss FROM (
    SELECT charge, pm_u//10000 AS x, count(*) AS k FROM spectra GROUP BY 1, 2) GROUP BY 1)""")
def agg23_counts(t):
    levels = t.spectra().groupBy("charge", F.expr("pm_u div 10000").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    return rounded(st.mean_sd_from_counts(levels, ["charge"], F.col("x"), F.col("k")), "mean", "sd")


@query("AGG24", """WITH c AS (SELECT score, t/(t + d) AS p, t/sum(n_target) OVER () AS r FROM (SELECT *, sum(n_target) OVER (ORDER BY score DESC) AS t, sum(n_decoy) OVER (ORDER BY score DESC) AS d FROM hit_levels)),
    a AS (SELECT p, r, (r - lag(r, 1, 0.0) OVER (ORDER BY score DESC))*(p + lag(p, 1, 1.0) OVER (ORDER BY score DESC))*0.5 AS area FROM c) SELECT round(sum(area) + (1 - max(r))*0.5*max_by(p, r), 6) AS auc FROM a""")
def agg24(t):
    return rounded(st.pr_auc(st.pr_curve(levels(t)), F.desc("score")), "auc")


CUTOFFS = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 6) AS top{k}" for k in st.TOP_CUTOFFS)


@query("AGG25", f"""WITH r AS (SELECT spectrum_id, charge, row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, seq, n_mass_u, charge) AS rank FROM (SELECT DISTINCT * FROM solutions)),
    f AS (SELECT s.spectrum_id, length(peptide) AS len, min(rank) AS rank FROM spectra s LEFT JOIN r ON r.spectrum_id = s.spectrum_id AND r.charge = s.charge GROUP BY 1, 2)
    SELECT len, count(*) AS n, {CUTOFFS} FROM f GROUP BY ROLLUP (len)""")
def agg25(t):
    from peakloom.functions.ordered import row_numbers
    from peakloom.operators.solutions import SOLUTION_ORDER

    ranked = row_numbers(t.solutions().distinct(), [ID], -F.floor(F.col("score") / 512), SOLUTION_ORDER(), "rank")
    truth = t.spectra().select(ID, "charge", F.length("peptide").cast("bigint").alias("len"))
    first = truth.join(ranked.groupBy(ID, "charge").agg(F.min("rank").alias("rank")), [ID, "charge"], "left")
    return rounded(st.benchmark_topk(first, "len"), *[f"top{k}" for k in st.TOP_CUTOFFS])


@query("AGG26", f"""WITH b AS (SELECT spectrum_id, charge AS best FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY prob DESC, charge) AS rn FROM quality) WHERE rn = 1),
    c AS (SELECT spectrum_id, charge, {SIZE_SQL} AS size_class, charge <> best AS wrong, pm_u + 10033*(coalesce(sqs, 0)//20 % 3 - 1) AS truth_u, unnest([0, 1, 2]) AS idx, unnest([pm_u, pm_u - 10033, pm_u + 10033]) AS cand_u FROM spectra JOIN b USING (spectrum_id))
    SELECT charge, size_class, CAST(idx AS INTEGER) AS idx, count(*) AS n, round(avg(CAST(abs(cand_u - truth_u) <= 2500 AS INTEGER)), 6) AS share_correct, round(avg(CAST(wrong AS INTEGER)), 6) AS share_wrong_charge FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 200""")
def agg26(t):
    best = sel.best_charge_quality(t.quality()).select(ID, "best_charge")
    truth = F.col("pm_u") + F.lit(mass.ISOTOPE_STEP) * (F.floor(F.coalesce("sqs", F.lit(0)) / 20) % 3 - 1)
    cands = F.posexplode(F.array(F.col("pm_u"), F.col("pm_u") - mass.ISOTOPE_STEP, F.col("pm_u") + mass.ISOTOPE_STEP)).alias("idx", "cand_u")
    rows = t.spectra().join(best, ID).withColumn("truth_u", truth).withColumn("size_class", mass.size_class(F.col("pm_u"), CLASSES))
    rows = rows.withColumn("wrong_charge", F.col("charge") != F.col("best_charge")).select("*", cands)
    return rounded(st.benchmark_precursor(rows, 2_500, 200), "share_correct", "share_wrong_charge")


TRUE_NODES = f"""SELECT n.spectrum_id, n.mass_u, n.score, CAST(CASE WHEN n.mass_u < pm_u*0.225 OR (charge <= 2 AND n.mass_u < lo_u + 1500000) THEN 0 WHEN n.mass_u > pm_u*0.775 OR (charge <= 2 AND n.mass_u > hi_u - 1500000) THEN 2 ELSE 1 END AS INTEGER) AS region,
    EXISTS (SELECT 1 FROM cuts c WHERE c.spectrum_id = n.spectrum_id AND abs(c.cut_u - n.mass_u) <= {ION_TOL}) AS is_true FROM graph_nodes n JOIN spectra USING (spectrum_id) JOIN peak_range USING (spectrum_id)"""


def true_nodes(t):
    from peakloom.functions.band import with_match

    parts = t.peak_parts()
    nodes, _, _ = t.graph()
    cuts = t.cuts().select(ID, F.col("cut_u").alias("mass_u"))
    marked = with_match(nodes.select(ID, "mass_u", "score"), cuts, ID, "mass_u", ION_TOL, "is_true", parts=parts)
    info = t.spectra().select(ID, "charge", "pm_u").join(pk.peak_range(t.peak_list()), ID)
    region = pk.classify_region(F.col("mass_u"), F.col("pm_u"), F.col("charge"), F.col("lo_u"), F.col("hi_u"))
    joined = marked.repartition(parts, ID).hint("merge").join(info.repartition(parts, ID), ID)
    return joined.select(ID, "mass_u", "score", region.alias("region"), "is_true")


GRID = list(range(-5, 36, 2))


@query("AGG27", f"""WITH n AS ({TRUE_NODES}), s AS (SELECT region, delta, count(*) FILTER (WHERE score + delta > 0)/count(*) AS share FROM n CROSS JOIN (SELECT unnest({GRID}) AS delta) WHERE is_true GROUP BY 1, 2)
    SELECT region, CAST(delta AS INTEGER) AS delta, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(abs(share - CASE WHEN region = 1 THEN 0.96 ELSE 0.94 END), 9), delta) AS rn FROM s) WHERE rn = 1""")
def agg27(t):
    return rounded(st.score_normaliser(true_nodes(t), GRID), "share")


@query("AGG28", f"""WITH n AS ({TRUE_NODES}), v AS (SELECT * FROM (VALUES (0, 6), (1, 9), (2, 4)) AS x(region, norm)) SELECT spectrum_id, mass_u, region, CAST(CASE WHEN score > norm THEN score ELSE (score + norm)/2 END AS DOUBLE) AS norm_score
    FROM n JOIN v USING (region) WHERE score >= -norm""")
def agg28(t):
    norms = t.spark.createDataFrame([(0, 6), (1, 9), (2, 4)], "region int, norm int")
    return st.normalise_scores(true_nodes(t), norms).select(ID, "mass_u", "region", "norm_score")


RANKED = f"""SELECT m.spectrum_id, m.peptide, m.cut, m.ion, r.rank/n_peaks AS rel_rank, mob.mobility FROM ion_matches m JOIN (SELECT spectrum_id, mass_u, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, mass_u) AS rank FROM peaks) r
    ON r.spectrum_id = m.spectrum_id AND r.mass_u = m.mass_u JOIN peak_range pr ON pr.spectrum_id = m.spectrum_id JOIN ({MOB}) mob ON mob.spectrum_id = m.spectrum_id WHERE {OBSERVED}"""


def ranked(t):
    ranks = pk.global_rank(t.peak_list()).select(ID, "mass_u", "rank")
    sizes = t.peak_list().groupBy(ID).agg(F.count(F.lit(1)).alias("n_peaks"))
    return (
        t.ion_matches(observed=True).join(ranks, [ID, "mass_u"]).join(sizes, ID).join(mobile(t).select(ID, "mobility"), ID)
        .select(ID, "peptide", "cut", "ion", (F.col("rank") / F.col("n_peaks")).alias("rel_rank"), "mobility")
    )


LEN_GROUP = "CASE " + " ".join(f"WHEN length(peptide) BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in st.LENGTH_GROUPS) + " END"


@query("AGG29", f"""WITH c AS (SELECT *, substr(peptide, cut, 1) AS prev_res, substr(peptide, cut + 1, 1) AS next_res, {LEN_GROUP} AS len_group, CASE WHEN cut <= 2 THEN 'n_term' WHEN length(peptide) - cut <= 2 THEN 'c_term' ELSE 'centre' END AS place FROM ({RANKED})),
    f AS (SELECT *, place AS form FROM c UNION ALL SELECT *, 'proline' AS form FROM c WHERE prev_res = 'P' OR next_res = 'P')
    SELECT form, len_group, mobility, prev_res, next_res, count(*) AS n, round(avg(rel_rank), 6) AS mean_rel_rank FROM f WHERE len_group IS NOT NULL GROUP BY ALL""")
def agg29(t):
    return rounded(st.fragment_summary(ranked(t)), "mean_rel_rank")


@query("AGG38", f"""SELECT substr(peptide, cut + d, 1) AS residue, mobility, CAST(d AS INTEGER) AS distance, count(*) AS n, round(avg(rel_rank), 6) AS mean_rel_rank FROM ({RANKED}), range(-2, 3) AS r(d)
    WHERE cut + d BETWEEN 1 AND length(peptide) GROUP BY 1, 2, 3 HAVING count(*) >= 7""")
def agg38(t):
    return rounded(st.relative_rank_by_residue(ranked(t)), "mean_rel_rank")


BINNED = f"SELECT CAST(CASE WHEN intensity IS NULL THEN 0 WHEN intensity < 25 THEN 1 ELSE 2 END AS INTEGER) AS level, ion, region FROM ({CONTEXT}) WHERE status <> 'not_visible'"


def binned(t):
    level = F.when(F.col("intensity").isNull(), 0).when(F.col("intensity") < 25, 1).otherwise(2)
    return contexts(t).filter("status <> 'not_visible'").select(level.alias("level"), "ion", "region")


P3 = f"SELECT level, ion, region, n, n/sum(n) OVER (PARTITION BY ion, region) AS p FROM (SELECT level, ion, region, count(*) AS n FROM ({BINNED}) GROUP BY 1, 2, 3)"
P2 = f"SELECT level, ion, n, n/sum(n) OVER (PARTITION BY ion) AS p FROM (SELECT level, ion, count(*) AS n FROM ({BINNED}) GROUP BY 1, 2)"


@query("AGG31", f"SELECT level, ion, region, n, round(p, 6) AS p FROM ({P3})")
def agg31(t):
    return rounded(st.conditional_probabilities(binned(t), "level", ["ion", "region"]), "p")


@query("AGG32", f"SELECT ion, round(sum(f.n*ln(f.p/c.p))/sum(f.n), 6) AS kl FROM ({P3}) f JOIN ({P2}) c USING (level, ion) GROUP BY 1")
def agg32(t):
    counts = st.context_counts(binned(t), "level", ["ion", "region"])
    fine, coarse = (st.conditional_probabilities(counts, "level", others, F.col("n")) for others in (["ion", "region"], ["ion"]))
    return rounded(st.weighted_kl(fine, coarse, "level", ["ion", "region"], ["ion"]), "kl")


@query("AGG33", f"SELECT level, ion, n, round(p, 6) AS p, round(rp, 6) AS random_p, round(ln(p/rp), 6) AS log_odds FROM ({P2}) JOIN (SELECT level, count(*)/sum(count(*)) OVER () AS rp FROM ({BINNED}) GROUP BY 1) USING (level)")
def agg33(t):
    counts = st.context_counts(binned(t), "level", ["ion"])
    table, random = (st.conditional_probabilities(counts, "level", others, F.col("n")) for others in (["ion"], []))
    return rounded(st.log_odds(table, random, "level"), "p", "random_p", "log_odds")


ION_NAMES = list(mass.IONS)
LEVEL_SQL = "CASE " + " ".join(f"WHEN rank <= {r} THEN {i}" for i, r in enumerate(st.RANK_LEVELS)) + f" ELSE {len(st.RANK_LEVELS)} END"


@query("AGG34", f"""SELECT CAST({LEVEL_SQL} AS INTEGER) AS level, {', '.join(f'''count(*) FILTER (WHERE ion = '{i}') AS "{i}"''' for i in ION_NAMES)}, count(*) FILTER (WHERE ion IS NULL) AS none, count(*) AS total
    FROM (SELECT p.spectrum_id, p.mass_u, row_number() OVER (PARTITION BY p.spectrum_id ORDER BY intensity DESC, p.mass_u) AS rank FROM peaks p) r LEFT JOIN (SELECT spectrum_id, mass_u, ion FROM ion_matches WHERE {OBSERVED}) m
    ON m.spectrum_id = r.spectrum_id AND m.mass_u = r.mass_u GROUP BY 1""")
def agg34(t):
    ranks = pk.global_rank(t.peak_list()).select(ID, "mass_u", "rank")
    seen = t.ion_matches(observed=True).select(ID, "mass_u", "ion")
    return st.ion_rank_histogram(ranks.join(seen, [ID, "mass_u"], "left"), ION_NAMES)


@query("AGG35", f"SELECT a.ion AS ion_a, b.ion AS ion_b, count(*) AS n FROM ion_matches a JOIN ion_matches b USING (spectrum_id, cut) WHERE a.{OBSERVED} AND b.{OBSERVED} AND a.ion < b.ion GROUP BY 1, 2")
def agg35(t):
    return st.ion_pairs(t.ion_matches(observed=True))


def cover_sql(classes: list[str], sets: str, pair: str, rounds: int = 6) -> str:
    """The rounds one by one; ``sets``: classes, ions, n."""
    cols = ", ".join([*classes, ""])
    part = f"PARTITION BY {', '.join(classes)} " if classes else ""
    using = f"LEFT JOIN b{{i}} b USING ({', '.join(classes)})" if classes else "LEFT JOIN b{i} b ON TRUE"
    steps = [f"s0 AS MATERIALIZED ({sets})"]
    for i in range(rounds):
        steps.append(f"""b{i} AS MATERIALIZED (SELECT {cols}x AS a, y AS b, CAST(sum(n) AS BIGINT) AS n, CAST({i} AS INTEGER) AS round FROM (SELECT {cols}n, ions, unnest(ions) AS x FROM s{i}) q, unnest(q.ions) AS u(y)
            WHERE x < y AND {pair} GROUP BY {cols}x, y QUALIFY row_number() OVER ({part}ORDER BY sum(n) DESC, x, y) = 1)""")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT s.* FROM s{i} s {using.format(i=i)} WHERE b.a IS NULL OR NOT (list_contains(ions, b.a) AND list_contains(ions, b.b)))")
    every = " UNION ALL ".join(f"SELECT {cols}round, a, b, n FROM b{i}" for i in range(rounds))
    return f"WITH {', '.join(steps)}, chosen AS ({every})"


_SETS = f"SELECT {{c}}ions, count(*) AS n FROM (SELECT spectrum_id, cut, {{c}}list_sort(list(DISTINCT ion)) AS ions, bool_or(ion = 'y'{{strong}}) AS covered FROM {{source}} WHERE {OBSERVED} GROUP BY ALL) WHERE len(ions) >= 2 AND NOT covered GROUP BY ALL"


@query("AGG35G", cover_sql([], _SETS.format(c="", strong="", source="ion_matches"), "TRUE") + " SELECT round, a AS ion_a, b AS ion_b, n FROM chosen")
def agg35g(t):
    return st.cover_pairs(t.ion_matches(observed=True).withColumn("strong_peak", F.lit(True)), [], ["y"], with_strong=False)


COVER_CLASSES = ["charge", "size_class", "region"]


@query("AGG35C", cover_sql(COVER_CLASSES, _SETS.format(c="charge, size_class, region, ", strong=" AND strong_peak OR ion = 'b' AND strong_peak",
    source=f"(SELECT c.*, k.mass_u IS NOT NULL AS strong_peak FROM ({CONTEXT}) c LEFT JOIN (SELECT DISTINCT spectrum_id, mass_u FROM strong_set) k USING (spectrum_id, mass_u))"), "(x IN ('b', 'y') OR y IN ('b', 'y'))")
    + " SELECT charge, size_class, region, round, CASE WHEN a IN ('b', 'y') THEN a ELSE b END AS ion_a, CASE WHEN a IN ('b', 'y') THEN b ELSE a END AS ion_b, n FROM chosen")
def agg35_cover(t):
    strong = t.strong().select(ID, "mass_u").distinct().withColumn("strong_peak", F.lit(True))
    seen = contexts(t).filter(OBSERVED).join(strong, [ID, "mass_u"], "left").withColumn("strong_peak", F.coalesce("strong_peak", F.lit(False)))
    return st.cover_pairs(seen, COVER_CLASSES, ["b", "y"])


@query("AGG36", """SELECT (SELECT count(*) FROM cuts) AS n_cuts, round(count(*)/(SELECT count(*) FROM cuts)/2000000*20000, 6) AS expected FROM cuts c JOIN peaks p ON p.spectrum_id = c.spectrum_id AND p.mass_u BETWEEN c.cut_u - 1000000 AND c.cut_u + 1000000""")
def agg36(t):
    return rounded(st.random_peak_density(t.cuts(), t.peak_list(), 1_000_000, 10_000), "expected")


@query("AGG41", """SELECT label, bin, n, round(sum(n) OVER (PARTITION BY label ORDER BY bin)/sum(n) OVER (PARTITION BY label), 6) AS cum_share FROM (SELECT quality AS label, CAST(least(floor(n_chars/(n_chars + 2000)*20), 19) AS INTEGER) AS bin, count(*) AS n FROM labelled GROUP BY 1, 2)""")
def agg41(t):
    prob = F.col("n_chars") / (F.col("n_chars") + 2000)
    return rounded(st.calibration_histogram(t.labelled(), "quality", prob), "cum_share")
