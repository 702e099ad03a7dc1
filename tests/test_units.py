"""Brute-force and property tests on small frames with a hot key."""

import random

from pyspark.sql import Window as W, functions as F

from peakloom.functions import band, ordered, scalars
from peakloom.operators import components, fdr, graph, keyed, peaks as pk, peptide as pep, similarity as sim


def hot_rows(n=600, seed=3):
    """A third of all rows in one key."""
    rnd = random.Random(seed)
    return [(1 if i % 3 == 0 else rnd.randrange(2, 30), i, rnd.randrange(0, 1000)) for i in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_sums_equal_a_plain_window(spark):
    df = spark.createDataFrame(hot_rows(), "k int, id long, v long")
    w = W.partitionBy("k").orderBy("v", "id").rowsBetween(W.unboundedPreceding, 0)
    plain = df.select("*", F.sum("v").over(w).alias("s"))
    split = ordered.running_sums(df, ["k"], F.floor(F.col("v") / 100), [F.col("v"), F.col("id")], {"s": F.col("v")})
    assert rows(plain) == rows(split)
    every = ordered.row_numbers(df, [], F.floor(F.col("v") / 100), [F.col("v"), F.col("id")])
    assert sorted(r["rn"] for r in every.collect()) == list(range(1, 601))


def test_range_numbers_equal_a_plain_window(spark):
    data = [(None if i % 50 == 7 else k, i, v, "same prefix " + str(v % 5)) for k, i, v in hot_rows()]
    df = spark.createDataFrame(data, "k int, id long, v long, s string").repartition(5)
    for keys, part in ((["k"], W.partitionBy("k")), ([], W.partitionBy(F.lit(1)))):
        order = [F.col("s").desc(), F.col("id")]
        plain = df.select("*", F.row_number().over(part.orderBy(*order)).cast("long").alias("rn"))
        assert sorted(map(str, plain.collect())) == sorted(map(str, ordered.range_numbers(df, keys, order).collect()))
    assert ordered.range_numbers(df.limit(0), ["k"], [F.col("id")]).count() == 0


def test_runs_of_close_points(spark):
    data = [(None if i % 90 == 7 else k, i, v * 3) for k, i, v in hot_rows()]
    df = spark.createDataFrame(data, "k int, id long, x long").repartition(4)
    for gap in (0, 4, 30):
        want = []
        for k in {r[0] for r in data}:
            run, last = 0, None
            for x, i in sorted((r[2], r[1]) for r in data if r[0] == k):
                run += last is None or x - last > gap
                last = x
                want.append((k, i, x, run))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in pk.sessionize(df, ["k"], "x", gap).collect())


def test_previous_row_crosses_buckets(spark):
    df = spark.createDataFrame(hot_rows(), "k int, id long, v long")
    plain = df.select("*", F.lag("v").over(W.partitionBy("k").orderBy("id")).alias("p"))
    split = ordered.previous_row(df, ["k"], F.floor(F.col("id") / 7), F.col("id"), {"p": F.col("v")})
    assert sorted(map(str, rows(plain))) == sorted(map(str, rows(split)))


def test_order_statistics(spark):
    data = hot_rows()
    df = spark.createDataFrame(data, "k int, id long, v long")
    picks = F.array(F.struct(F.lit(1).alias("pick"), (F.floor(F.col("total") / 2) + 1).alias("k")))
    got = {r["k"]: r["value"] for r in ordered.order_statistics(df, ["k"], F.col("v"), picks, 50).collect()}
    for k in {r[0] for r in data}:
        vals = sorted(v for kk, _, v in data if kk == k)
        assert got[k] == vals[len(vals) // 2]


def test_band_join_and_neighbours(spark):
    data = [(k, v) for k, _, v in hot_rows()]
    pts = spark.createDataFrame(sorted(set(data)), "k int, x long")
    probe = pts.select("k", F.col("x").alias("at"))
    got = rows(band.band_join(probe, pts, ["k"], F.col("at") - 13, F.col("at") + 21, "x", 10).select("k", "at", "x"))
    want = sorted((k, a, x) for k, a in set(data) for kk, x in set(data) if k == kk and a - 13 <= x <= a + 21)
    assert got == want
    near = band.with_neighbours(pts, "k", "x", -13, 21, F.collect_list("x"))
    flat = rows(near.select("k", F.col("x").alias("at"), F.explode("near").alias("x")))
    assert flat == want
    away = band.with_neighbours(pts, "k", "x", 5, 21, F.collect_list("x"))
    assert rows(away.select("k", F.col("x").alias("at"), F.explode("near").alias("x"))) == [t for t in want if 5 <= t[2] - t[1]]


def brute_groups(proteins, peptides):
    held = {}
    for p, q in peptides:
        held.setdefault(p, []).append(q)
    founders, out = [], {}
    for p, adj in sorted(proteins, key=lambda x: (-x[1], x[0])):
        mine = held.get(p)
        if not mine:
            continue
        best, count = None, 0
        for f in founders:
            c = sum(q in held[f] for q in mine)
            if c > count:
                best, count = f, c
        if 2 * count >= len(mine):
            out[p] = (best, False)
        else:
            founders.append(p)
            out[p] = (p, True)
    return sorted((p, g, f) for p, (g, f) in out.items())


def test_protein_groups_match_the_sequential_rule(spark):
    for seed, hot in ((1, 256), (2, 3), (5, 1)):
        rnd = random.Random(seed)
        proteins = [(i, rnd.randrange(0, 40)) for i in range(60)]
        peptides = [(i, rnd.randrange(0, 6) if rnd.random() < 0.4 else rnd.randrange(6, 80)) for i in range(60) for _ in range(rnd.randrange(1, 7))]
        got = fdr.protein_groups(
            spark.createDataFrame(proteins, "protein_id long, adj_score long"), spark.createDataFrame(peptides, "protein_id long, peptide long"), hot=hot
        )
        assert rows(got.select("protein_id", "group_id", "is_founder")) == brute_groups(proteins, peptides)


def test_protein_groups_with_hot_peptides_only(spark):
    """No bound settles a protein whose peptides are all hot; each round settles a block, not one."""
    rnd = random.Random(4)
    proteins = [(i, rnd.randrange(0, 5000)) for i in range(3_000)]
    peptides = [(i, q) for i, _ in proteins for q in rnd.sample(range(100), 4)]
    data = spark.createDataFrame(proteins, "protein_id long, adj_score long"), spark.createDataFrame(peptides, "protein_id long, peptide long")
    rounds = []
    got = fdr.protein_groups(*data, hot=20, block=128, rounds=rounds)
    assert rows(got.select("protein_id", "group_id", "is_founder")) == brute_groups(proteins, peptides)
    assert sum(rounds) > 200 and len(rounds) <= sum(rounds) / 20


def test_one_peptide_that_all_proteins_hold(spark):
    proteins = [(i, i % 1000) for i in range(10_000)]
    data = spark.createDataFrame(proteins, "protein_id long, adj_score long"), spark.createDataFrame([(i, q) for i, _ in proteins for q in (-1, i)], "protein_id long, peptide long")
    rounds = []
    got = fdr.protein_groups(*data, rounds=rounds)
    assert rows(got.filter("is_founder").select("protein_id")) == [(999,)] and len(rounds) == 1
    assert got.filter("group_id = 999").count() == 10_000


def test_protein_groups_count_every_alignment(spark):
    proteins = spark.createDataFrame([(1, 20), (2, 10)], "protein_id long, adj_score long")
    peptides = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (2, "c"), (2, "c")], "protein_id long, peptide string")
    # 1 of 4 alignments is shared, although 1 of 2 peptides is
    assert rows(fdr.protein_groups(proteins, peptides).select("protein_id", "group_id", "is_founder")) == [(1, 1, True), (2, 2, True)]


def test_group_report(spark):
    proteins = spark.createDataFrame([(1, False, 30, 2, 20, 20), (2, True, 10, 1, 10, 10)], "protein_id long, is_decoy boolean, total long, n_peptides long, best_score long, adj_score long")
    groups = spark.createDataFrame([(1, 1, True), (2, 1, False)], "protein_id long, group_id long, is_founder boolean")
    names = spark.createDataFrame([(1, "P1|one"), (2, "P2|two")], "protein_id long, name string")
    report = fdr.group_report(groups, proteins, names, fdr.fdr_levels(proteins, "adj_score"))
    got = rows(report.select("group_id", "n_proteins", "n_peptides", "adj_score", "total", "fdr", "top_name", "accession"))
    assert got == [(1, 2, 2, 20, 30, 0.0, "P1|one", "P1"), (1, 2, 2, 20, 30, 0.0, "P1|one", "P2")]


def test_history_adds_up(spark):
    from peakloom.operators import candidates as cand

    old = spark.createDataFrame([("A", 2), ("B", 1)], "seq string, uses long")
    new = spark.createDataFrame([("B",), ("C",), ("C",)], "seq string")
    assert rows(cand.update_history(old, new)) == [("A", 2), ("B", 2), ("C", 2)]


def test_representative_counts_all_copies(spark):
    peaks = [(s, m, i) for s in (1, 2, 3) for m, i in ((1_000_000, 10), (2_000_000, 20))] + [(9, 1_000_100, 10), (9, 2_000_100, 20)]
    spectra = spark.createDataFrame([(s, 9_000_000, 2) for s in (1, 2, 3, 9)], "spectrum_id long, mz_u long, charge int")
    pk = spark.createDataFrame(peaks, "spectrum_id long, mass_u long, intensity long")
    pairs = sim.similar_pairs(spectra, pk, 1_000, 6_500, 5_000, 0.5)
    # each of the four has three partners of similarity 1
    got = rows(sim.representatives(sim.clusters(pairs), pairs, sim.fold_copies(spectra, pk)))
    assert got == [(1, 1, 3_000_000)]


def test_tags_of_any_length(spark):
    import pytest

    tags = spark.createDataFrame([(1, t) for t in ("A" * 13, "B" + "A" * 13 + "C", "DEF", "XDEFX", "GH")], "set_id long, tag string")
    assert [t for _, t in rows(pep.drop_covered(tags, "set_id"))] == ["A" * 13, "DEF", "GH"]
    proteins = spark.createDataFrame([(7, "XXABCXX")], "protein_id long, seq string")
    found = pep.tag_lookup(spark.createDataFrame([("ABC",), ("ABCX",)], "tag string"), proteins)
    assert rows(found.select("tag", "pos")) == [("ABC", 2), ("ABCX", 2)]
    with pytest.raises(Exception, match="no index for tags of this length"):
        pep.tag_lookup(spark.createDataFrame([("AB",)], "tag string"), proteins).collect()


def test_score_grid(spark):
    levels = spark.createDataFrame([(-2, 0.9), (2, 0.5), (5, 0.1)], "score long, fdr double")
    assert rows(fdr.score_to_fdr(levels)) == [(0, 1.0), (1, 1.0), (2, 0.5), (3, 0.5), (4, 0.5), (5, 0.1)]


def test_components_with_a_hub(spark):
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 501)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(40))
    assert all(got[i] == 100 for i in range(100, 131))
    assert got[501] == 500 and len(got) == 40 + 31 + 2


def test_copies_fold_to_a_star_and_stay_in_the_cluster(spark):
    peaks = [(s, m, i) for s in range(12) for m, i in ((1_000_000, 10), (2_000_000, 20))]
    peaks += [(50, 1_000_100, 10), (50, 2_000_100, 20), (60, 7_000_000, 3)]
    ids = sorted({p[0] for p in peaks})
    spectra = spark.createDataFrame([(s, 9_000_000, 2) for s in ids], "spectrum_id long, mz_u long, charge int")
    pk = spark.createDataFrame(peaks, "spectrum_id long, mass_u long, intensity long")
    pairs = sim.similar_pairs(spectra, pk, 1_000, 6_500, 5_000, 0.5)
    got = rows(pairs)
    assert len(got) == 12
    assert {b for a, b, s in got} == set(range(1, 12)) | {50}
    assert rows(sim.clusters(pairs).select("spectrum_id")) == [(i,) for i in [*range(12), 50]]


def edit(a, b):
    norm = str.maketrans("IKm", "LQF")
    a, b = a.translate(norm), b.translate(norm)
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        new = [i]
        for j, q in enumerate(b, 1):
            swap = 0 if p == q else 0.5 if {p, q} == {"N", "D"} else 1
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + swap))
        row = new
    return float(row[-1])


def test_weighted_edit_distance(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("ANDIKLQFm") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    data = [(a, b) for a in words[:30] for b in words[30:]]
    df = spark.createDataFrame(data, "a string, b string").select("a", "b", pep.weighted_edit_distance(F.col("a"), F.col("b")).alias("d"))
    assert all(r["d"] == edit(r["a"], r["b"]) for r in df.collect())


def test_expected_query_score(spark):
    """Hand-computed from the rule: a residue counts (p - 0.275) / 0.725, the first one p; then the discounts."""
    w = lambda p: (p - 0.275) / 0.725
    plain = 0.9 + 6 * w(0.9)
    cases = {
        "ASLDTLE": plain,  # nothing risky
        "AXLDTLE": plain - w(0.9),  # X counts nothing
        "AZLDTLE": plain - w(0.9) / 2,  # Z counts half
        "ASLFTLE": plain - 0.1 * 1.9,  # F may be oxidised M
        "ASLDTLQ": plain - 1.0 * 1.9,  # Q at the end is taken for K
        "ASLDTLK": plain,  # K at the end is sure
        "ASKDTLE": plain - 0.75 * 1.9,  # K in the middle is hardly ever K
        "BKLDTLE": plain - 0.55 * 1.9,  # after the boundary it is
        "ASLDTL": float("-inf"),  # too short
    }
    # a residue call that is wrong with probability 0.3 leaves the better side of it
    before, after = 0.9 + w(0.9) - 7 + 3, 3 * w(0.9) - 3 - 1
    cases["ASLWTLE"] = 0.7 * plain + 0.3 * max(before + w(0.9), after)
    df = spark.createDataFrame([(s, [0.9] * len(s)) for s in cases], "seq string, probs array<double>")
    for r in df.select("seq", pep.expected_query_score(F.col("seq"), F.col("probs")).alias("s")).collect():
        assert r["s"] == cases[r["seq"]] or abs(r["s"] - cases[r["seq"]]) < 1e-9, (r["seq"], r["s"], cases[r["seq"]])


def size_thresholds(spark, vals, per=60, most=5, gap=2_000_000, grid=100_000):
    df = spark.createDataFrame([(2, v) for v in vals], "charge int, pm_u long")
    return [r["threshold"] for r in keyed.size_thresholds(df, 10, 20, 100, per, most, gap, grid).orderBy("idx").collect()]


def test_size_thresholds_large_rule(spark):
    rnd = random.Random(9)
    per, most, gap, grid = 60, 5, 2_000_000, 100_000
    vals = sorted(rnd.randrange(5_000_000, 40_000_000) for _ in range(400))
    got = size_thresholds(spark, vals)
    assert 1 <= len(got) <= most - 1 and all(t % grid == 0 for t in got)
    assert all(b - a > gap - grid for a, b in zip([0, *got], got))
    cut = [sum(v < t for v in vals) for t in got]
    assert all(b - a >= len(vals) // most - per for a, b in zip([0, *cut], cut))
    # worked: 300 values well apart make five classes; each of the first four takes its share of 60 and a value or two more
    even = [10_000_000 + 3_000_000 * i for i in range(300)]
    cut = [0, *(even.index(t) for t in size_thresholds(spark, even))]
    assert len(cut) == 5 and all(60 <= b - a <= 62 for a, b in zip(cut, cut[1:]))
    # worked: too close together for the gap, so no class can end
    assert size_thresholds(spark, [1_000_000 + i for i in range(300)]) == []


def test_wide_beam_finds_every_path(spark):
    nodes = [(1, m, s) for m, s in ((0, 0), (10, 5), (20, 7), (30, 1), (40, 9))]
    hops = [(0, 10), (10, 20), (20, 30), (30, 40), (10, 30), (0, 20), (20, 40)]
    score = dict((m, s) for _, m, s in nodes)
    nd = spark.createDataFrame([(k, m, s, 1) for k, m, s in nodes], "spectrum_id long, mass_u long, score long, n_frags long")
    ed = spark.createDataFrame([(1, a, b, "G", 1, 0, score[b]) for a, b in hops], "spectrum_id long, from_u long, to_u long, label string, n_res int, err_u long, to_score long")
    fb = spark.createDataFrame([(1, 10, 40)], "spectrum_id long, lo_u long, hi_u long")
    got = rows(graph.extend_paths(nd, ed, fb, 10, 4, 100, 25, 2).select("nodes", "score"))
    want = []

    def walk(path):
        if len(path) >= 3:
            want.append((path, sum(score[m] for m in path) - 25 * (10 in path and 40 in path)))
        for a, b in hops:
            if a == path[-1]:
                walk(path + [b])

    for m in score:
        walk([m])
    assert got == sorted(want)


def test_scalars(spark):
    df = spark.createDataFrame([(1, "a;;b;c", "/x/y.z/run.mgf")], "n int, t string, p string")
    r = df.select(
        scalars.log_sum_exp(F.lit(1.0), F.lit(2.0)).alias("l"), scalars.split_fields(F.col("t"), ";").alias("s"), scalars.file_stem(F.col("p")).alias("f"),
        scalars.binomial_cdf(F.col("n"), 3, 0.5).alias("b"),
    ).first()
    assert abs(r["l"] - 2.313261687518223) < 1e-12 and r["s"] == ["a", "b", "c"] and r["f"] == "run" and abs(r["b"] - 0.5) < 1e-12
    assert scalars.min_count_for(3, 0.5, 0.6) == 2
    runs = spark.createDataFrame([("k", v) for v in (1, 2, 3, 4, 7, 9, 10, 11, 12)], "k string, v int")
    assert scalars.range_text(runs, ["k"], "v").first()["ranges"] == "1-4,7,9-12"


def test_fdr_never_falls_and_query_parts_cover_all(spark):
    from peakloom.operators import candidates as cand

    hits = spark.createDataFrame([(i % 50, i % 7 == 0) for i in range(500)], "score long, is_decoy boolean")
    levels = [r["fdr"] for r in fdr.fdr_levels(hits).orderBy(F.desc("score")).collect()]
    assert levels == sorted(levels)
    sets = spark.createDataFrame([(i, "A" * (5 + i % 9), i % 4) for i in range(200)], "set_id long, seq string, score long")
    parts = cand.split_query(sets, 100, 16)
    assert parts.count() == 200 and parts.agg(F.max("cum")).first()[0] == sum(5 + i % 9 for i in range(200))
