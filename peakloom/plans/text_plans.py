"""Peptides, proteins, k-mers and tags."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Window as W, functions as F

from peakloom.functions import mass, text
from peakloom.functions.ordered import range_numbers
from peakloom.operators import candidates as cand, modifications as mods, peptide as pep
from peakloom.plans.registry import query
from peakloom.session import scratch_path
from peakloom.sources.readers import read_modifications

ID = "spectrum_id"
MODS = "C=57:L+14:R+14"
MODIFIED = "SELECT spectrum_id, '[' || CAST(mz_u // 10000 AS VARCHAR) || ']' || replace(CASE WHEN charge = 3 THEN replace(peptide, 'L', 'L+14') ELSE peptide END, 'RI', 'R+14I') AS peptide FROM annotated"


def modified(t):
    p = F.when(F.col("charge") == 3, F.replace("peptide", F.lit("L"), F.lit("L+14"))).otherwise(F.col("peptide"))
    gap = F.concat(F.lit("["), F.floor(F.col("mz_u") / 10000).cast("string"), F.lit("]"))
    return t.annotated().select(ID, F.concat(gap, F.replace(p, F.lit("RI"), F.lit("R+14I"))).alias("peptide"))


@query("SEQ1", rf"""SELECT spectrum_id, gap_text, valid, CAST(pos - 1 AS INTEGER) AS pos, tokens[pos] AS token FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS pos FROM (
    SELECT spectrum_id, regexp_extract(peptide, '^\[([0-9]+)\]', 1) AS gap_text, regexp_replace(regexp_replace(peptide, '^\[[0-9]+\]', ''), '[A-Z](?:[+-][0-9]+)?', '', 'g') = '' AS valid,
    regexp_extract_all(regexp_replace(peptide, '^\[[0-9]+\]', ''), '[A-Z](?:[+-][0-9]+)?') AS tokens FROM ({MODIFIED})))""")
def seq1(t):
    return pep.tokenize_peptide(modified(t)).drop("peptide")


@query("SEQ2", "SELECT spectrum_id, CAST(sum(mass) + 190184 AS BIGINT) AS mh_u FROM peptide_residues GROUP BY 1")
def seq2(t):
    return t.annotated().select(ID, (mass.peptide_mass(F.col("peptide")) + mass.WATER_PROTON).alias("mh_u"))


@query("SEQ3", rf"""WITH tok AS (SELECT spectrum_id, unnest(regexp_extract_all(regexp_replace(peptide, '^\[[0-9]+\]', ''), '[A-Z](?:[+-][0-9]+)?')) AS token FROM ({MODIFIED}))
    SELECT spectrum_id, CAST(sum(mass + CASE WHEN token = 'C' THEN 570000 WHEN length(token) > 1 THEN 140000 ELSE 0 END) AS BIGINT) AS mass_u FROM tok JOIN residues ON residue = substr(token, 1, 1) GROUP BY 1""")
def seq3(t):
    return pep.modified_masses(modified(t), MODS).select(ID, "mass_u")


# A rule file with every kind of place: fixed, anywhere, both termini, first and last residue, second residue, last but one.
RULES = """#residue shift type place symbol name
C       57.021464   FIXED      ALL      C+57   carbamidomethyl
L       14.01565    OPTIONAL   ALL      L+14   methyl
N_TERM  42.010565   OPTIONAL   N_TERM   ^+42   acetyl
C_TERM  -0.984016   OPTIONAL   C_TERM   $-1    amide
Q       -17.026549  OPTIONAL   N_TERM   Q-17   pyro glu
D       21.981943   OPTIONAL   C_TERM   D+22   sodium
R       14.01565    OPTIONAL   2        R+14   methyl
E       21.981943   OPTIONAL   -2       E+22   sodium
H       57.021464   OPTIONAL   ALL      H+57   carbamidomethyl
short line"""
CHOSEN = "C+57:L+14:^+42:$-1:Q-17:D+22:R+14:E+22"
MARKED = """SELECT spectrum_id, CASE WHEN charge = 2 AND spectrum_id % 5 < 3 THEN '^+42' ELSE '' END || replace(replace(replace(CASE WHEN charge = 3 THEN replace(peptide, 'L', 'L+14') ELSE peptide END, 'RI', 'R+14I'), 'QU', 'Q-17U'), 'EN', 'E+22N')
    || CASE WHEN spectrum_id % 7 = 1 THEN 'D+22' WHEN spectrum_id % 7 = 2 THEN '$-1' WHEN spectrum_id % 7 = 3 THEN 'H+57' ELSE '' END AS peptide FROM annotated"""


def marked(t):
    at, three = F.col(ID), F.when(F.col("charge") == 3, F.replace("peptide", F.lit("L"), F.lit("L+14"))).otherwise(F.col("peptide"))
    for old, new in (("RI", "R+14I"), ("QU", "Q-17U"), ("EN", "E+22N")):
        three = F.replace(three, F.lit(old), F.lit(new))
    head = F.when((F.col("charge") == 2) & (at % 5 < 3), "^+42").otherwise("")
    tail = F.when(at % 7 == 1, "D+22").when(at % 7 == 2, "$-1").when(at % 7 == 3, "H+57").otherwise("")
    return t.annotated().select(ID, F.concat(head, three, tail).alias("peptide"))


def _rules_sql() -> str:
    fields = [line.split(None, 5) for line in RULES.split("\n")[1:]]
    rows = [(f[0], int((Decimal(f[1]) * 10_000).to_integral_value(ROUND_HALF_UP)), f[2] == "FIXED", f[3] if f[3].isalpha() or "_" in f[3] else "PLACE", 0 if "_" in f[3] or f[3] == "ALL" else int(f[3]), f[4]) for f in fields if len(f) == 6 and f[4] in CHOSEN.split(":")]
    values = ", ".join(f"('{a}', {b}, {c}, '{d}', {e}, '{g}')" for a, b, c, d, e, g in rows)
    return f"""rules AS (SELECT * FROM (VALUES {values}) AS v(aa, shift, fixed, region, place, symbol)),
    based AS (SELECT residue, mass + coalesce(sum(shift), 0) AS mass FROM residues LEFT JOIN rules ON aa = residue AND fixed GROUP BY residue, mass),
    tk AS (SELECT residue AS token, mass, 'ALL' AS region, 0 AS place FROM based UNION ALL SELECT symbol, coalesce(mass, 0) + shift, CASE aa WHEN 'N_TERM' THEN 'BEFORE' WHEN 'C_TERM' THEN 'AFTER' ELSE region END, place FROM rules LEFT JOIN based ON residue = aa WHERE NOT fixed)"""


@query("SEQ3T", rf"""WITH {_rules_sql()}, s AS (SELECT spectrum_id, regexp_replace(peptide, '[A-Z^$](?:[+-][0-9]+)?', '', 'g') = '' AS clean, regexp_extract_all(peptide, '[A-Z^$](?:[+-][0-9]+)?') AS ts FROM ({MARKED})),
    c AS (SELECT *, CAST(starts_with(ts[1], '^') AS INTEGER) AS lead, len(ts) - CAST(starts_with(ts[1], '^') AS INTEGER) - CAST(starts_with(ts[-1], '$') AS INTEGER) AS n FROM s),
    e AS (SELECT spectrum_id, clean, n, i - 1 - lead AS pos, ts[i] AS token FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM c)),
    j AS (SELECT e.*, mass, CASE region WHEN 'ALL' THEN pos BETWEEN 0 AND n - 1 WHEN 'N_TERM' THEN pos = 0 WHEN 'C_TERM' THEN pos = n - 1 WHEN 'BEFORE' THEN pos = -1 WHEN 'AFTER' THEN pos = n WHEN 'PLACE' THEN pos = CASE WHEN place > 0 THEN place - 1 ELSE n + place END ELSE FALSE END AS fits FROM e LEFT JOIN tk USING (token))
    SELECT spectrum_id, CAST(any_value(n) AS INTEGER) AS n_residues, count(*) FILTER (WHERE length(token) > 1) AS n_modified, bool_and(fits) AND any_value(clean) AS valid,
      CASE WHEN bool_and(fits) AND any_value(clean) THEN CAST(sum(mass) AS BIGINT) END AS mass_u FROM j GROUP BY 1""")
def seq3t(t):
    path = scratch_path(t.spark, "rules")
    t.spark.createDataFrame([(line,) for line in RULES.split("\n")], "value string").write.text(path)
    return mods.masses_by_rules(marked(t), [ID], mods.chosen_rules(read_modifications(t.spark, path), CHOSEN))


@query("SEQ4", "SELECT spectrum_id, replace(replace(substr(peptide, 1, length(peptide) - 1), 'I', 'L'), 'K', 'Q') || replace(right(peptide, 1), 'I', 'L') AS seq FROM annotated")
def seq4(t):
    return t.annotated().select(ID, text.equate_residues(F.col("peptide")).alias("seq"))


@query("SEQ5", f"SELECT spectrum_id, regexp_replace(peptide, '[+-][0-9]+', '', 'g') AS seq FROM ({MODIFIED})")
def seq5(t):
    return modified(t).select(ID, pep.strip_modifications(F.col("peptide")).alias("seq"))


MOBILITY = "CASE WHEN length(regexp_replace(peptide, '[^RHK]', '', 'g')) < charge THEN 'mobile' WHEN length(regexp_replace(peptide, '[^R]', '', 'g')) >= charge THEN 'non_mobile' ELSE 'partial' END"


@query("SEQ6", f"SELECT spectrum_id, {MOBILITY} AS mobility FROM annotated")
def seq6(t):
    return t.annotated().select(ID, pep.proton_mobility(F.col("peptide"), F.col("charge")).alias("mobility"))


# A path is the inside of the peptide, read with I for L, its start mass off by up to 9 Da.
PATHS = """SELECT spectrum_id, peptide, replace(substr(peptide, 2, length(peptide) - 2), 'L', 'I') AS path, mass + 10000*(mz_u // 1000 % 10) AS n_mass
    FROM annotated JOIN residues ON residue = substr(peptide, 1, 1)"""


def paths(t):
    first = mass.residue_map()[F.substring("peptide", 1, 1)]
    inner = F.substring("peptide", F.lit(2), F.length("peptide") - 2)
    return t.annotated().select(
        ID, "peptide", F.translate(inner, "L", "I").alias("path"), (first + F.lit(10000) * (F.floor(F.col("mz_u") / 1000) % 10)).alias("n_mass")
    )


@query("SEQ7", f"""WITH p AS ({PATHS}), m AS (SELECT spectrum_id, sum(mass) OVER (PARTITION BY spectrum_id ORDER BY cut) AS pm FROM peptide_residues)
    SELECT spectrum_id, position(translate(path, 'IK', 'LQ') IN translate(p.peptide, 'IK', 'LQ')) > 0 AND ((n_mass = 0 AND position(translate(path, 'IK', 'LQ') IN translate(p.peptide, 'IK', 'LQ')) = 1)
      OR bool_or(abs(pm - n_mass) < 60000)) AS correct FROM p JOIN m USING (spectrum_id) GROUP BY spectrum_id, path, p.peptide, n_mass""")
def seq7(t):
    return paths(t).select(ID, pep.is_correct(F.col("path"), F.col("n_mass"), F.col("peptide")).alias("correct"))


@query("SEQ8", f"""WITH p AS ({PATHS}), a AS (SELECT spectrum_id, cut AS i, translate(residue, 'I', 'L') AS r, sum(mass) OVER (PARTITION BY spectrum_id ORDER BY cut) AS m FROM peptide_residues),
    b AS (SELECT spectrum_id, i, translate(residue, 'I', 'L') AS r, n_mass + sum(mass) OVER (PARTITION BY spectrum_id ORDER BY i) AS m FROM (SELECT *, unnest(range(1, length(path) + 1)) AS i FROM p) x JOIN residues ON residue = substr(x.path, x.i, 1))
    SELECT p.spectrum_id, CAST(count(DISTINCT b.i) AS INTEGER) AS n_correct FROM p LEFT JOIN (b JOIN a ON a.spectrum_id = b.spectrum_id AND a.r = b.r AND abs(a.m - b.m) < 10000) ON p.spectrum_id = b.spectrum_id GROUP BY 1""")
def seq8(t):
    return paths(t).select(ID, pep.correct_residues(F.col("path"), F.col("n_mass"), F.col("peptide")).alias("n_correct"))


# all pairs whose distance with free I/L, K/Q and N/D is at most 2, then the table of the weighted distance
_EDIT = """list_reduce(list_transform(range(1, length(x) + 1), lambda i: [CAST(i AS DOUBLE)]), lambda row, e:
    list_reduce(list_transform(range(1, length(y) + 1), lambda j: [CAST(j AS DOUBLE)]), lambda acc, f: list_append(acc, least(acc[-1] + 1, row[CAST(f[1] AS INTEGER) + 1] + 1,
      row[CAST(f[1] AS INTEGER)] + CASE WHEN substr(x, CAST(e[1] AS INTEGER), 1) = substr(y, CAST(f[1] AS INTEGER), 1) THEN 0
        WHEN substr(x, CAST(e[1] AS INTEGER), 1) || substr(y, CAST(f[1] AS INTEGER), 1) IN ('ND', 'DN') THEN 0.5 ELSE 1 END)), [row[1] + 1]),
    list_transform(range(0, length(y) + 1), lambda j: CAST(j AS DOUBLE)))[-1]"""


@query("SEQ9", f"""WITH q AS (SELECT DISTINCT seq AS query, translate(seq, 'IK', 'LQ') AS x FROM candidates), d AS (SELECT DISTINCT seq AS target, translate(seq, 'IK', 'LQ') AS y FROM benchmark_words WHERE seq <> ''),
    p AS (SELECT * FROM q JOIN d ON abs(length(query) - length(target)) <= 2 WHERE levenshtein(translate(x, 'D', 'N'), translate(y, 'D', 'N')) <= 2)
    SELECT * FROM (SELECT query, target, CAST({_EDIT} AS DOUBLE) AS distance FROM p) WHERE distance <= 2""")
def seq9(t):
    q = t.candidates().select(F.col("seq").alias("query"))
    d = t.words("benchmark", "item_id", 1).select(F.col("seq").alias("target"))
    return pep.edit_distance_pairs(q, d, 2, index="query")


@query("SEQ10", """WITH g AS (SELECT translate(peptide, 'AVLIMCFWYSTNQKRHDEGP', '00000011122223334455') AS s FROM annotated), r AS (SELECT s, CAST(k AS INTEGER) AS n_res, unnest(range(1, length(s) - k + 2)) AS i, k FROM g, range(1, 4) AS x(k))
    SELECT CASE WHEN i = 1 THEN 'start' WHEN i = length(s) - k + 1 THEN 'end' ELSE 'middle' END AS place, n_res, substr(s, i, k) AS category, count(*) AS n FROM r GROUP BY ALL""")
def seq10(t):
    return pep.composition_categories(t.annotated())


def _match_sql() -> str:
    il = "(m IN ('I', 'L') AND p IN ('I', 'L'))"
    zq = "m = 'Z' AND p IN ('Q', 'K')"
    lead = f"CASE WHEN m = p THEN 1.0 WHEN m = 'X' THEN 0.0 WHEN {il} THEN 1.0 WHEN {zq} THEN 0.5 ELSE -0.5 END"
    rest = f"CASE WHEN m = p OR {il} THEN 1.0 WHEN {zq} THEN 0.5 ELSE -0.5 END"

    def side(outer, inner, m, p, score):
        return f"""SELECT spectrum_id, off, sum({score}) AS s FROM (SELECT spectrum_id, off, substr({m}) AS m, substr({p}) AS p FROM (SELECT *, unnest(range(1, least(length({outer}) - off, length({inner})) + 1)) AS j
        FROM (SELECT *, unnest(range(0, length({outer}))) AS off FROM q))) GROUP BY 1, 2"""

    return f"""WITH q AS (SELECT spectrum_id, 'BX' || replace(path, 'K', 'Z') AS query, peptide FROM ({PATHS})),
    a AS ({side('query', 'peptide', 'query, off + j, 1', 'peptide, j, 1', lead)}), b AS ({side('peptide', 'query', 'query, j, 1', 'peptide, off + j, 1', rest)})
    SELECT spectrum_id, CAST(round(max(s), 6) AS DOUBLE) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1"""


@query("SEQ11", _match_sql())
def seq11(t):
    q = paths(t).withColumn("query", F.concat(F.lit("BX"), F.translate("path", "K", "Z")))
    return q.select(ID, F.round(pep.match_score(F.col("query"), F.col("peptide")), 6).alias("score"))


@query("SEQ12", "SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 3))) AS kmer FROM proteins) GROUP BY 1")
def seq12(t):
    return pep.kmers(t.proteins(), 3).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("SEQ13", """SELECT protein_id, name, seq FROM proteins UNION ALL SELECT protein_id, 'XXX_' || protein_id AS name, coalesce(string_agg(c, '' ORDER BY md5(concat_ws(':', 7, protein_id, i - 1)), c), '') AS seq
    FROM (SELECT protein_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS i FROM proteins) GROUP BY protein_id""")
def seq13(t):
    return pep.decoy_shuffle(t.proteins(), 7)


def scored_paths(t):
    probs = F.transform(F.split("seq", ""), lambda c, i: ((F.ascii(c) * 37 + i * 11) % 100) / 100)
    seqs = paths(t).withColumn("seq", F.concat(F.lit("B"), F.col("path")))
    return seqs.withColumn("probs", probs)


def _cases(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"


_HALF = "CASE {c} WHEN 'X' THEN 0.0 WHEN 'Z' THEN ({v})*0.5 ELSE {v} END"
_AFTER_B = "substr(seq, 1, 1) = 'B'"
_LOSS = f"""CASE substr(seq, i, 1) WHEN 'K' THEN CASE WHEN {_AFTER_B} AND i = 2 THEN {1 - pep.K_FIRST} ELSE 0 END + CASE WHEN i > CASE WHEN {_AFTER_B} THEN 2 ELSE 0 END AND i < n THEN {1 - pep.K_MIDDLE} ELSE 0 END + CASE WHEN i = n THEN {1 - pep.K_LAST} ELSE 0 END
    WHEN 'Q' THEN CASE WHEN {_AFTER_B} AND i = 2 THEN {pep.K_FIRST} ELSE 0 END + CASE WHEN i > CASE WHEN {_AFTER_B} THEN 2 ELSE 0 END AND i < n THEN {pep.K_MIDDLE} ELSE 0 END + CASE WHEN i = n THEN {pep.K_LAST} ELSE 0 END
    WHEN 'm' THEN {pep.OXIDISED_FOR_F} WHEN 'F' THEN {1 - pep.OXIDISED_FOR_F} ELSE 0 END"""


@query("SEQ14", f"""WITH q AS (SELECT spectrum_id, 'B' || path AS seq, length(path) + 1 AS n FROM ({PATHS})), l AS (SELECT *, list_transform(range(1, n + 1), lambda i: CAST((ascii(substr(seq, i, 1))*37 + (i - 1)*11) % 100 AS DOUBLE)/100) AS p FROM q),
    m AS (SELECT *, list_transform(range(1, n + 1), lambda i: CAST({_HALF.format(c="substr(seq, i, 1)", v=f"CASE WHEN i = 1 THEN p[1] ELSE (p[i] - {pep.MIN_RESIDUE_PROB})/(1 - {pep.MIN_RESIDUE_PROB}) END")} AS DOUBLE)) AS a,
      list_transform(range(1, n + 1), lambda i: CAST(({_LOSS})*(p[i] + 1) AS DOUBLE)) AS d FROM l),
    s AS (SELECT *, list_sum(a) - list_sum(d) AS simple FROM m),
    r AS (SELECT spectrum_id, seq, simple, i, w, list_sum(a[1:i]) - n + i AS before, coalesce(list_sum(a[i + 2:n]), 0) - i - 1 AS after FROM (SELECT *, {_cases(pep.SINGLE_RISK, "substr(seq, i + 1, 1)")} AS w FROM (SELECT *, unnest(range(1, n - 1)) AS i FROM s)) WHERE w IS NOT NULL
      UNION ALL SELECT spectrum_id, seq, simple, i, w, list_sum(a[1:i]) - n + i, coalesce(list_sum(a[i + 2:n]), 0) - i - 1 FROM (SELECT *, {_cases(pep.DOUBLE_RISK, "substr(seq, i + 1, 2)")} AS w FROM (SELECT *, unnest(range(1, n - 2)) AS i FROM s)) WHERE w IS NOT NULL),
    t AS (SELECT spectrum_id, min(w*simple + (1 - w)*greatest(before, after)) AS worst FROM r GROUP BY 1)
    SELECT spectrum_id, seq, round(CASE WHEN n < 5 THEN CAST('-inf' AS DOUBLE) ELSE least(simple, worst) END, 6) AS score FROM s LEFT JOIN t USING (spectrum_id)""")
def seq14(t):
    p = scored_paths(t)
    return p.select(ID, "seq", F.round(pep.expected_query_score(F.col("seq"), F.col("probs"), 5), 6).alias("score"))


@query("SEQ15", f"""SELECT spectrum_id, n_mass, CAST(g AS INTEGER) AS n_x, CASE WHEN g IS NULL THEN path ELSE 'B' || repeat('X', g) || path END AS variant FROM (SELECT *, unnest(CASE WHEN len(gs) = 0 THEN [NULL] ELSE gs END) AS g FROM (
    SELECT *, CASE WHEN n_mass < 10000 THEN [0] ELSE list_filter(range(1, 8), lambda g: g*570215 - 5000 <= n_mass AND n_mass <= g*1860793 + 5000) END AS gs FROM (SELECT spectrum_id, path, n_mass*(spectrum_id % 9) AS n_mass FROM ({PATHS}))))""")
def seq15(t):
    p = paths(t).withColumn("n_mass", F.col("n_mass") * (F.col(ID) % 9))
    return pep.gap_variants(p, "path", "n_mass").select(ID, "n_mass", "n_x", "variant")


# how likely a gap of a half-Dalton bin is a run of g residues
_SUMS = ", ".join(
    f"r{g} AS (SELECT {'mass' if g == 1 else f's.m + mass'} AS m, CAST({'count(*)' if g == 1 else 'sum(s.n)'} AS BIGINT) AS n FROM residues{'' if g == 1 else f' JOIN r{g - 1} s ON s.m + mass <= {(pep.GAP_BINS + 1) * 5_000}'} GROUP BY 1)"
    for g in range(1, pep.MOST_GAP + 1)
)
GAP_SHARES = f"""{_SUMS}, gw AS (SELECT (2*m + 5000)//10000 + d AS gap_bin, g, sum(n*k) AS w FROM ({' UNION ALL '.join(f'SELECT {g} AS g, m, n, {20 ** (pep.MOST_GAP - g)} AS k FROM r{g}' for g in range(1, pep.MOST_GAP + 1))}), range(-1, 2) AS x(d) GROUP BY 1, 2),
    gs AS MATERIALIZED (SELECT gap_bin, CAST(g AS INTEGER) AS g, w/sum(w) OVER (PARTITION BY gap_bin) AS share FROM gw QUALIFY gap_bin < {pep.GAP_BINS})"""


@query("SEQ15C", f"""WITH {GAP_SHARES}, p AS (SELECT spectrum_id, path, n_mass*(spectrum_id % 4) AS n_gap, n_mass*(spectrum_id % 3) + 1000000*(spectrum_id % 5) AS c_gap FROM ({PATHS})), gr AS (SELECT * FROM gs WHERE share > {pep.GAP_SHARE}),
    b AS (SELECT p.*, CASE WHEN n_gap >= 10000 THEN g END AS n_x, CASE WHEN n_gap < 10000 THEN CASE WHEN path LIKE 'B%' THEN path ELSE 'B' || path END WHEN g IS NULL THEN path ELSE 'B' || repeat('X', g) || path END AS variant
      FROM p LEFT JOIN gr ON n_gap >= 10000 AND gap_bin = (2*n_gap + 5000)//10000)
    SELECT spectrum_id, n_gap, c_gap, n_x, CAST(NULL AS INTEGER) AS c_x, variant FROM b UNION ALL
    SELECT spectrum_id, n_gap, c_gap, n_x, g, variant || repeat('X', g) || residue FROM b JOIN residues ON residue IN ('K', 'R') AND c_gap >= mass + 560000 JOIN gr ON gap_bin = (2*(c_gap - mass) + 5000)//10000""")
def seq15c(t):
    m, i = F.col("n_mass"), F.col(ID)
    p = paths(t).select(ID, "path", (m * (i % 4)).alias("n_gap"), (m * (i % 3) + F.lit(1_000_000) * (i % 5)).alias("c_gap"))
    return pep.boundary_variants(p, "path", "n_gap", "c_gap").drop("path")


# called probabilities are those of SEQ14
@query("SEQ15M", f"""WITH {GAP_SHARES}, q AS (SELECT spectrum_id, 'B' || path AS seq FROM ({PATHS}) WHERE length(path) >= 4), c AS (SELECT spectrum_id, seq, i, substr(seq, i, 1) AS c, ((ascii(substr(seq, i, 1))*37 + (i - 1)*11) % 100)/100 AS p FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM q)),
    r AS (SELECT spectrum_id, seq, s.start, c.i, mass, greatest(p, {pep.LEAST_PROB}) AS p, p > {pep.WEAK_PROB} OR mass IS NULL AS strong, sum(mass) OVER w AS m FROM (SELECT spectrum_id, unnest(range(1, length(seq) - 2)) AS start FROM q) s JOIN c USING (spectrum_id) LEFT JOIN residues ON residue = c WHERE c.i > s.start
      WINDOW w AS (PARTITION BY spectrum_id, s.start ORDER BY c.i)),
    o AS (SELECT *, bool_or(strong OR m > {pep.RUN_MASS}) OVER (PARTITION BY spectrum_id, start ORDER BY i) AS over FROM r),
    k AS (SELECT spectrum_id, seq, start, CAST(count(*) AS INTEGER) AS n_weak, sum(mass) AS m, list_reduce(list(CAST(p AS DOUBLE) ORDER BY i), lambda a, b: a*b) AS p FROM o WHERE NOT over GROUP BY ALL),
    v AS (SELECT spectrum_id, seq, CAST(start AS INTEGER) AS start, n_weak, g AS n_x, substr(seq, 1, start) || repeat('X', g) || substr(seq, start + n_weak + 1) AS variant FROM k JOIN gs ON gap_bin = (2*m + 5000)//10000
      WHERE share > {pep.WEAK_GAP_SHARE} AND n_weak >= 2 AND p <= {pep.RUN_PROB} AND start + n_weak < length(seq))
    SELECT * FROM v WHERE length(replace(variant, 'X', '')) > 4 AND 2*(length(variant) - length(replace(variant, 'X', ''))) <= length(variant) AND length(variant) - length(replace(variant, 'X', '')) <= {pep.MOST_GAP} AND variant NOT LIKE 'X%' AND variant NOT LIKE '%X'""")
def seq15m(t):
    return pep.weak_run_variants(scored_paths(t).select(ID, "seq", "probs"), "seq", "probs").drop("probs")


# every letter window of n letters, as the n ways to cut a text into pieces of n
_TAGS_AT = " UNION ALL ".join(
    f"SELECT protein_id, s - 1 + {n}*unnest(range(0, len(w))) AS pos, unnest(w) AS tag FROM (SELECT protein_id, s, regexp_extract_all(substr(seq, s), '[A-Z]{{{n}}}') AS w FROM proteins, range(1, {n + 1}) AS x(s))"
    for n in (3, 4, 5, 6)
)


@query("JN12", f"""WITH tags AS (SELECT DISTINCT seq AS tag FROM benchmark_words WHERE length(seq) BETWEEN 3 AND 6), k AS ({_TAGS_AT})
    SELECT protein_id, CAST(pos AS INTEGER) AS pos, tag FROM k SEMI JOIN tags USING (tag)""")
def jn12(t):
    # tags are words of 3 to 6 letters; that is the feature, as in JN16
    tags = t.words("benchmark", "item_id", 3).filter(F.length("seq") <= 6)
    return pep.tag_lookup(tags.select(F.col("seq").alias("tag")), t.proteins())


def _mass_sql(target: int, tol: int) -> str:
    longest = (target + tol) // min(mass.RESIDUE_MASS.values()) + 1
    leads = ", ".join(f"lead(pre, {i}) OVER w" if i else "pre" for i in range(longest))
    return f"""WITH c AS (SELECT protein_id, unnest(string_split(seq, '')) AS ch, generate_subscripts(string_split(seq, ''), 1) AS i FROM proteins WHERE seq <> ''),
    m AS (SELECT protein_id, i, coalesce(mass, 1000000000000) AS mass FROM c LEFT JOIN residues ON residue = ch),
    p AS (SELECT *, CAST(sum(mass) OVER (PARTITION BY protein_id ORDER BY i) AS BIGINT) AS pre FROM m),
    l AS (SELECT protein_id, i, pre - mass AS before, [{leads}] AS ends FROM p WINDOW w AS (PARTITION BY protein_id ORDER BY i)),
    f AS (SELECT *, len(list_filter(ends, lambda e: e - before < {target - tol})) + 1 AS n FROM l)
    SELECT f.protein_id, CAST(i - 1 AS INTEGER) AS start, substr(seq, i, n) AS peptide, ends[n] - before AS mass_u FROM f JOIN proteins USING (protein_id) WHERE ends[n] - before BETWEEN {target - tol} AND {target + tol}"""


@query("JN13", _mass_sql(8_000_000, 5_000))
def jn13(t):
    return pep.candidates_with_mass(t.proteins(), 8_000_000, 5_000)


RANKED = "SELECT set_id, seq, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, seq) AS rank FROM (SELECT set_id, seq, max(score) AS score FROM candidates GROUP BY 1, 2)"


def ranked(t):
    best = t.candidates().groupBy("set_id", "seq").agg(F.max("score").alias("score"))
    return range_numbers(best, ["set_id"], cand.BEST_FIRST(), "rank").select("set_id", "seq", "rank")


@query("JN16", f"""WITH r AS ({RANKED}), n AS (SELECT set_id, count(*) AS n FROM r GROUP BY 1), tags AS (SELECT DISTINCT seq AS tag FROM benchmark_words WHERE length(seq) BETWEEN 3 AND 6),
    g AS (SELECT DISTINCT set_id, seq, rank, substr(seq, i, k) AS tag FROM (SELECT *, unnest(range(1, length(seq) - k + 2)) AS i FROM r, range(3, 7) AS x(k)))
    SELECT set_id, tag, min(rank) AS first_rank, round(count(*) FILTER (WHERE rank <= 5)/least(any_value(n), 5), 6) AS share5, round(count(*) FILTER (WHERE rank <= 20)/least(any_value(n), 20), 6) AS share20, round(count(*)/any_value(n), 6) AS share_all
    FROM g JOIN tags USING (tag) JOIN n USING (set_id) GROUP BY 1, 2""")
def jn16(t):
    tags = t.words("benchmark", "item_id", 3).filter(F.length("seq") <= 6).select(F.col("seq").alias("tag"))
    out = pep.contained_tags(tags, ranked(t))
    return out.select("set_id", "tag", "first_rank", *[F.round(c, 6).alias(c) for c in ("share5", "share20", "share_all")])


@query("JN17", """WITH t AS (SELECT DISTINCT set_id, seq AS tag FROM conversation_words WHERE length(seq) >= 3), g AS (SELECT DISTINCT set_id, tag AS longer, substr(tag, i, k) AS tag FROM
    (SELECT *, unnest(range(1, length(tag) - k + 2)) AS i FROM t, range(3, 64) AS x(k) WHERE k < length(tag)))
    SELECT set_id, tag FROM t ANTI JOIN (SELECT g.set_id, longer AS tag FROM g SEMI JOIN t USING (set_id, tag)) USING (set_id, tag)""")
def jn17(t):
    tags = t.words("conversations", "conv_id", 3).select("set_id", F.col("seq").alias("tag"))
    return pep.drop_covered(tags, "set_id")


@query("SNK4", """SELECT 'TRUE_' || (rn - 1)//10 AS record, string_agg(seq, '' ORDER BY rn) AS seq FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS rn FROM (SELECT DISTINCT seq FROM candidates)) GROUP BY (rn - 1)//10""")
def snk4(t):
    from peakloom.sources.writers import fasta_records

    return fasta_records(t.candidates().select("seq").distinct(), "seq", 10)


@query("SNK5", "SELECT file_idx, spectrum_id AS scan, round(mz_u/10000, 4) AS mz FROM spectra")
def snk5(t):
    from peakloom.sources.writers import mz_list

    return mz_list(t.spectra().withColumn("scan", F.col(ID)))


@query("SNK2", """SELECT least(mz_u, 20000000)//50000 AS bucket, count(*) AS n FROM spectra JOIN peak_range USING (spectrum_id) WHERE n_peaks >= 25 AND mz_u > 0 GROUP BY 1""")
def snk2(t):
    from peakloom.session import scratch_path
    from peakloom.sources.writers import write_mz_buckets

    path = scratch_path(t.spark, "buckets")
    counts = t.peaks().groupBy(ID).agg(F.count(F.lit(1)).alias("n_peaks"))
    write_mz_buckets(t.spectra().select(ID, "mz_u", "charge").join(counts, ID), path, 50_000, 20_000_000, 25)
    return t.spark.read.parquet(path).groupBy(F.col("bucket").cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
