"""Selection, projection, key joins, sets and collection counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions import mass
from peakloom.operators import keyed, selection as sel
from peakloom.plans.registry import query

SPEC = "spectrum_id, mz_u, charge, pm_u, file_idx, sqs"
SPEC_COLS = SPEC.split(", ")


@query("SEL1", f"""SELECT {SPEC} FROM spectra WHERE mz_u BETWEEN 9100000 AND 9800000 AND charge BETWEEN 2 AND 3
    AND (sqs IS NULL OR sqs BETWEEN 200 AND 900)""")
def sel1(t):
    return sel.select_spectra(t.spectra(), (9_100_000, 9_800_000), (2, 3), (200, 900)).select(SPEC_COLS)


@query("SEL2", f"""SELECT {SPEC} FROM spectra WHERE pm_u BETWEEN 9500000 AND 19500000
    AND (sqs IS NULL OR sqs >= 300) AND length(peptide) < 6""")
def sel2(t):
    return sel.select_by_mass(t.spectra(), (9_500_000, 19_500_000), 300, 0, True, 6).select(SPEC_COLS)


@query("SEL3", f"SELECT {SPEC} FROM spectra WHERE mz_u BETWEEN 9200000 AND 9500000 AND charge = 2")
def sel3(t):
    return sel.select_mz_range(t.spectra(), 9_200_000, 9_500_000, 2).select(SPEC_COLS)


@query("SEL4", """SELECT spectrum_id, peptide FROM (SELECT spectrum_id, CASE WHEN charge = 3 THEN
    replace(peptide, 'L', 'L+14') ELSE peptide END AS peptide FROM spectra)
    WHERE length(peptide) > 3 AND NOT regexp_matches(peptide, '[A-Z][+-][0-9]')""")
def sel4(t):
    shifted = F.when(F.col("charge") == 3, F.replace("peptide", F.lit("L"), F.lit("L+14"))).otherwise(F.col("peptide"))
    return sel.drop_modified(sel.keep_annotated(t.spectra().select("spectrum_id", shifted.alias("peptide"))))


@query("SEL5", """SELECT spectrum_id, mz_u, n_peaks FROM spectra JOIN (SELECT spectrum_id, count(*) AS n_peaks
    FROM peaks GROUP BY 1 HAVING count(*) >= 30) USING (spectrum_id)""")
def sel5(t):
    return sel.min_peaks(t.spectra().select("spectrum_id", "mz_u"), t.peaks(), 30)


@query("SEL6", """SELECT spectrum_id, file_idx, mz_u, n_peaks FROM (
    SELECT *, lag(mz_u) OVER w AS pm, lag(n_peaks) OVER w AS pn FROM spectra
    JOIN (SELECT spectrum_id, count(*) AS n_peaks FROM peaks GROUP BY 1) USING (spectrum_id)
    WINDOW w AS (PARTITION BY file_idx ORDER BY spectrum_id))
    WHERE NOT coalesce(pn = n_peaks AND abs(mz_u - pm) <= 50000, FALSE)""")
def sel6(t):
    with_n = sel.min_peaks(t.spectra().select("spectrum_id", "file_idx", "mz_u"), t.peaks(), 1)
    return sel.dedup_adjacent(with_n, 50_000, 256).select("spectrum_id", "file_idx", "mz_u", "n_peaks")


@query("SEL7", """SELECT row_id, file_idx, scan FROM (SELECT *, lag(scan) OVER (PARTITION BY file_idx ORDER BY row_id) AS ps
    FROM scans) WHERE ps IS NULL OR ps <> scan""")
def sel7(t):
    return sel.dedup_scan(t.scans().select("row_id", "file_idx", "scan"))


@query("SEL8", "SELECT spectrum_id, mz_u FROM spectra ORDER BY md5(concat_ws(':', spectrum_id, 112233)), spectrum_id LIMIT 700")
def sel8(t):
    return sel.sample_n(t.spectra().select("spectrum_id", "mz_u"), "spectrum_id", 700, 112233)


@query("SEL9", """SELECT spectrum_id, charge FROM (SELECT *, row_number() OVER (PARTITION BY charge ORDER BY spectrum_id) AS rn FROM spectra)
    WHERE rn <= CASE charge WHEN 1 THEN 100 WHEN 2 THEN 250 WHEN 3 THEN 40 ELSE 0 END""")
def sel9(t):
    return sel.sample_per_charge(t.spectra().select("spectrum_id", "charge"), {1: 100, 2: 250, 3: 40})


@query("SEL10", """SELECT spectrum_id, mass_u, intensity FROM peaks WHERE NOT (mass_u BETWEEN 1000000 AND 1500000
    OR mass_u BETWEEN 4000000 AND 4100000)""")
def sel10(t):
    return sel.exclude_mz_ranges(t.peak_list(), [(1_000_000, 1_500_000), (4_000_000, 4_100_000)])


@query("SEL11", """SELECT spectrum_id, file_idx, CAST(best_charge AS INTEGER) AS best_charge, prob FROM spectra JOIN (
    SELECT spectrum_id, charge AS best_charge, prob FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY prob DESC, charge) AS rn
    FROM quality) WHERE rn = 1) USING (spectrum_id) WHERE prob >= 17""")
def sel11(t):
    return sel.filter_quality(t.spectra().select("spectrum_id", "file_idx"), t.quality(), 17)


@query("SEL12", f"SELECT {SPEC} FROM spectra WHERE pm_u <= 19000000")
def sel12(t):
    return sel.max_precursor(t.spectra(), 19_000_000).select(SPEC_COLS)


@query("SEL13", """SELECT spectrum_id, coalesce(unordered, 0) AS unordered, coalesce(bad_mass, 0) AS bad_mass,
    coalesce(bad_intensity, 0) AS bad_intensity, coalesce(n_read, 0) AS n_read, coalesce(n_read, 0) <> coalesce(n_stored, 0) AS count_differs
    FROM spectra LEFT JOIN (SELECT l_partkey AS spectrum_id, count(DISTINCT l_orderkey) AS n_stored FROM lineitem GROUP BY 1) USING (spectrum_id)
    LEFT JOIN (SELECT spectrum_id, count(*) FILTER (WHERE mass_u <= pm) AS unordered, count(*) FILTER (WHERE mass_u <= 0) AS bad_mass,
      count(*) FILTER (WHERE intensity < 0) AS bad_intensity, count(*) AS n_read FROM (
      SELECT *, lag(mass_u) OVER (PARTITION BY spectrum_id ORDER BY pos, mass_u) AS pm FROM peaks) GROUP BY 1) USING (spectrum_id)
    WHERE coalesce(unordered + bad_mass + bad_intensity, 0) > 0 OR coalesce(n_read, 0) <> coalesce(n_stored, 0)""")
def sel13(t):
    stored = t.raw("lineitem").groupBy(F.col("l_partkey").alias("spectrum_id")).agg(F.countDistinct("l_orderkey").alias("n_stored"))
    return sel.sanity_check(t.spectra(), t.peaks(), stored, 20_000)


@query("PRJ1", "SELECT spectrum_id, mz_u*charge-(charge-1)*10073 AS mh_u, (pm_u+(charge-1)*10073)//charge AS back_mz_u FROM spectra")
def prj1(t):
    return t.spectra().select(
        "spectrum_id",
        mass.precursor_mass(F.col("mz_u"), F.col("charge")).alias("mh_u"),
        mass.precursor_mz(F.col("pm_u"), F.col("charge")).alias("back_mz_u"),
    )


@query("PRJ2", """SELECT spectrum_id, CAST(z AS INTEGER) AS as_charge, CAST(mz_u*z-(z-1)*10073 AS BIGINT) AS as_pm_u FROM spectra, range(1, 5) AS r(z)""")
def prj2(t):
    return sel.mass_for_charges(t.spectra().select("spectrum_id", "mz_u")).select("spectrum_id", "as_charge", "as_pm_u")


@query("PRJ3", """SELECT spectrum_id, mass_u, round(intensity*1000/sum(intensity) OVER (PARTITION BY spectrum_id), 6) AS norm FROM peaks""")
def prj3(t):
    return sel.normalize_intensity(t.peak_list()).select("spectrum_id", "mass_u", F.round("norm", 6).alias("norm"))


@query("PRJ4", """SELECT spectrum_id, mass_u, round(ln(intensity*1000/sum(intensity) OVER (PARTITION BY spectrum_id)), 6) AS log_tic FROM peaks""")
def prj4(t):
    return sel.log_tic_intensity(t.peak_list()).select("spectrum_id", "mass_u", F.round("log_tic", 6).alias("log_tic"))


CANDIDATE_MASSES = """SELECT spectrum_id, charge, CAST(idx - 1 AS INTEGER) AS idx, kept[idx] AS cand_u FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS idx FROM (
    SELECT spectrum_id, charge, list_reduce(list_filter([[pm_u - 10033], [pm_u + 10033], [CASE WHEN charge >= 2 THEN s2 - 10073 END],
      [CASE WHEN charge >= 3 THEN s2 + 10073 END]], lambda x: x[1] IS NOT NULL),
      lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < 2500)) > 0 THEN acc ELSE list_concat(acc, x) END, [pm_u, s2]) AS kept
    FROM (SELECT *, pm_u + 5000 * (coalesce(sqs, 0) // 20 % 5) AS s2 FROM spectra)))"""


def candidate_masses(t):
    second = F.col("pm_u") + F.lit(5000) * (F.floor(F.coalesce("sqs", F.lit(0)) / 20) % 5)
    return sel.extra_pm_candidates(t.spectra(), [-mass.ISOTOPE_STEP, mass.ISOTOPE_STEP], 2500, second)


@query("PRJ5", CANDIDATE_MASSES)
def prj5(t):
    return candidate_masses(t)


@query("JN1", """SELECT spectrum_id, file_idx, theo_mz_u, ann_charge, abs(theo_mz_u - mz_u) > 4000000 AS mismatch FROM (
    SELECT s.spectrum_id, s.file_idx, s.mz_u, a.charge AS ann_charge, (p.total_u + 190184 + (a.charge - 1)*10073)//a.charge AS theo_mz_u
    FROM spectra s JOIN annotated a USING (file_idx, spectrum_id)
    JOIN (SELECT spectrum_id, CAST(sum(mass) AS BIGINT) AS total_u FROM peptide_residues GROUP BY 1) p ON p.spectrum_id = s.spectrum_id)""")
def jn1(t):
    ann = t.annotated().select("file_idx", F.col("spectrum_id").alias("scan"), F.col("charge").alias("ann_charge"), F.col("peptide").alias("ann_peptide"))
    spectra = t.spectra().select("spectrum_id", "file_idx", F.col("spectrum_id").alias("scan"), "mz_u")
    return keyed.annotate(spectra, ann, 4_000_000).select("spectrum_id", "file_idx", "theo_mz_u", "ann_charge", "mismatch")


EXCLUDED = "SELECT DISTINCT generation, file_idx, scan FROM scans WHERE scan % 3 = 0"


@query("JN2", f"SELECT row_id, generation, file_idx, scan FROM scans ANTI JOIN ({EXCLUDED}) USING (generation, file_idx, scan)")
def jn2(t):
    s = t.scans().drop("ts")
    return keyed.exclude_scans(s, s.filter(F.col("scan") % 3 == 0).select(keyed.SCAN_KEY))


@query("JN3", f"SELECT row_id, generation, file_idx, scan FROM scans SEMI JOIN ({EXCLUDED}) USING (generation, file_idx, scan)")
def jn3(t):
    s = t.scans().drop("ts")
    return keyed.include_scans(s, s.filter(F.col("scan") % 3 == 0).select(keyed.SCAN_KEY))


@query("SET1", """SELECT spectrum_id, mz_u, 0 AS source_idx FROM spectra WHERE charge = 1 UNION ALL
    SELECT spectrum_id, mz_u, 1 AS source_idx FROM spectra WHERE charge <> 1 UNION ALL SELECT row_id AS spectrum_id, scan AS mz_u, 2 AS source_idx FROM scans""")
def set1(t):
    s = t.spectra()
    return keyed.union_collections(
        [
            s.filter("charge = 1").select("spectrum_id", "mz_u"),
            s.filter("charge <> 1").select("spectrum_id", "mz_u"),
            t.scans().select(F.col("row_id").alias("spectrum_id"), F.col("scan").alias("mz_u")),
        ]
    )


@query("SET2", """SELECT seq FROM (SELECT seq FROM candidates INTERSECT SELECT seq FROM benchmark_words)""")
def set2(t):
    return keyed.intersection(t.candidates(), t.words("benchmark", "item_id", 1), ["seq"])


@query("SET3", """SELECT set_id, seq, score FROM candidates WHERE seq NOT IN (SELECT seq FROM benchmark_words)""")
def set3(t):
    return keyed.minus_keep_duplicates(t.candidates(), t.words("benchmark", "item_id", 1), ["seq"]).select("set_id", "seq", "score")


@query("SET4", "SELECT seq, max(score) AS score FROM candidates GROUP BY seq")
def set4(t):
    return keyed.distinct_sequences(t.candidates())


@query("AGG1", """SELECT charge, file_type, count(*) AS n, min(mz_u) AS min_mz_u, max(mz_u) AS max_mz_u, min(charge) AS min_charge, max(charge) AS max_charge,
    CAST(grouping(charge, file_type) AS INTEGER) AS level FROM spectra GROUP BY CUBE (charge, file_type)""")
def agg1(t):
    return keyed.collection_stats(t.spectra())


@query("AGG2", """SELECT charge, CAST(i AS INTEGER) AS pick, pm_u AS value, total FROM (SELECT *, row_number() OVER (PARTITION BY charge ORDER BY pm_u) AS rn,
    count(*) OVER (PARTITION BY charge) AS total FROM spectra), range(1, 20) AS r(i) WHERE rn = total*i//20 + 1""")
def agg2(t):
    return keyed.mass_ventiles(t.spectra())


@query("AGG3", """SELECT charge, CAST(idx AS INTEGER) AS idx, pm_u AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY charge ORDER BY pm_u) AS rn,
    count(*) OVER (PARTITION BY charge) AS total FROM spectra), range(0, 2) AS r(idx)
    WHERE (total BETWEEN 150 AND 664 AND idx = 0 AND rn = total//2 + 1) OR (total BETWEEN 665 AND 49999 AND rn = (idx + 1)*(total//3) + 1)""")
def agg3(t):
    return keyed.size_thresholds(t.spectra(), 150, 665, 50_000)


@query("AGG30", """SELECT generation, file_idx, min(scan) AS min_scan, max(scan) AS max_scan, count(*) AS n_scans, count(*) FILTER (WHERE n > 1) AS n_repeated,
    CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT generation, file_idx, scan, count(*) AS n FROM scans GROUP BY ALL) GROUP BY 1, 2""")
def agg30(t):
    return keyed.source_coverage(t.scans())
