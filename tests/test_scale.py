"""Plans and steps that must hold on larger tables."""

import random

from peakloom.functions.band import band_join
from peakloom.operators import graph, similarity as sim, stats as st
from peakloom.sources import readers as rd


def test_band_join_sends_no_side_whole(spark):
    rng = random.Random(3)
    intervals = [(rng.randrange(4), rng.randrange(1000)) for _ in range(200)]
    points = [(rng.randrange(4), rng.randrange(1000)) for _ in range(200)]
    left = spark.createDataFrame(intervals, "k int, at bigint")
    right = spark.createDataFrame(points, "k int, p bigint")
    joined = band_join(left, right, ["k"], left["at"] - 30, left["at"] + 30, "p", 40)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    want = sorted((k, a, p) for k, a in intervals for q, p in points if k == q and abs(a - p) <= 30)
    assert sorted(tuple(r) for r in joined.select("k", "at", "p").collect()) == want


def test_random_peak_density_counts_without_a_row_for_each_cut(spark):
    cuts = spark.createDataFrame([(1, 1, 1000, 3000), (1, 2, 2000, 3000), (2, 1, 9000, 9500)], "spectrum_id bigint, cut int, cut_u bigint, total_u bigint")
    peaks = spark.createDataFrame([(1, 1500), (1, 2500), (1, 9000), (2, 100)], "spectrum_id bigint, mass_u bigint")
    found = st.random_peak_density(cuts, peaks, 500, 10)
    assert "ObjectHash" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "LeftOuter" not in plan
    assert [tuple(r) for r in found.collect()] == [(3, 3 / 3 / 1000 * 20)]
    assert [tuple(r) for r in st.random_peak_density(cuts.filter("cut > 9"), peaks, 500, 10).collect()] == [(0, None)]


def test_long_edges_shuffle_no_pairs(spark):
    nodes = spark.createDataFrame([(1, m, 1, 1) for m in range(0, 9_000_000, 400_000)], "spectrum_id bigint, mass_u bigint, score bigint, n_frags bigint")
    singles = spark.createDataFrame([], "spectrum_id bigint, from_u bigint, to_u bigint, label string, n_res int, err_u bigint, to_score bigint")
    plan = graph.long_edges(nodes, singles, 5_000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the nodes with their residues
    twice = nodes.unionByName(nodes.limit(1).selectExpr("spectrum_id", "mass_u", "score", "0L as n_frags"))
    assert graph.long_edges(twice, singles, 5_000).count() == graph.long_edges(nodes, singles, 5_000).count() > 0


def test_paths_write_nothing_between_hops(spark, monkeypatch):
    nodes = spark.createDataFrame([(s, m, m % 7, 1) for s in (1, 2) for m in (0, 10, 20, 30)], "spectrum_id bigint, mass_u bigint, score bigint, n_frags bigint")
    edges = spark.createDataFrame(
        [(s, a, b, label, 1, 0, b % 7) for s in (1, 2) for a, b, label in ((0, 10, "G"), (0, 20, "A"), (10, 20, "S"), (20, 30, "K"))],
        "spectrum_id bigint, from_u bigint, to_u bigint, label string, n_res int, err_u bigint, to_score bigint",
    )
    barred = spark.createDataFrame([(2, 0, 30)], "spectrum_id bigint, lo_u bigint, hi_u bigint")
    monkeypatch.setattr(graph, "cut_lineage", lambda df: (_ for _ in ()).throw(AssertionError("written")))
    found = graph.extend_paths(nodes, edges, barred, 5, 3, 2, min_len=2)
    got = sorted((r["spectrum_id"], r["tag"], r["score"], tuple(r["nodes"])) for r in found.collect())
    plain = [("AK", 8, (0, 20, 30)), ("GS", 9, (0, 10, 20)), ("GSK", 11, (0, 10, 20, 30)), ("SK", 11, (10, 20, 30))]
    assert got == [(1, *p) for p in plain] + [(2, t, v - 25 * (n[0] == 0 and n[-1] == 30), n) for t, v, n in plain]


def test_scored_pairs_equal_pair_by_pair_and_shuffle_none(spark, monkeypatch):
    rng = random.Random(8)
    lists = {s: {rng.randrange(0, 3000) * 40: rng.randrange(1, 30) for _ in range(rng.randrange(1, 14))} for s in range(300)}
    spectra = spark.createDataFrame([(s, rng.randrange(0, 300), rng.choice([1, 2, None])) for s in lists], "spectrum_id bigint, mz_u bigint, charge int")
    peaks = spark.createDataFrame([(s, m, i) for s, p in lists.items() for m, i in p.items()], "spectrum_id bigint, mass_u bigint, intensity bigint")
    plain = sim.cosine_matched(sim.candidate_pairs(spectra, peaks, 50, 900), peaks, 700)
    want = {(r.a, r.b): (r.n_matched, round(r.similarity, 9)) for r in plain.collect()}
    for weight, most in ((1 << 17, 10_000), (300, 10_000), (300, 10)):
        monkeypatch.setattr(sim, "UNIT_WEIGHT", weight)
        found = sim.scored_pairs(spectra, peaks, 50, 900, 700, most_peaks=most)
        got = [((r.a, r.b), (r.n_matched, round(r.similarity, 9))) for r in found.collect()]
        assert len(want) > 100 and len(got) == len(want) and dict(got) == want
    found = sim.scored_pairs(spectra, peaks, 50, 900, 700)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    forest = sim.scored_pairs(spectra, peaks, 50, 900, 700, 0.2, forest=True)
    whole = plain.filter("similarity >= 0.2")
    groups = [sorted(tuple(r) for r in sim.clusters(p).collect()) for p in (forest, whole)]
    assert groups[0] == groups[1] and forest.count() < whole.count()


def test_joined_dta_files(spark, tmp_path):
    texts = [f"{1000 + i}.5 2\tscan={i}\n{100 + i}.5 3\n{200 + i}.25 4" for i in range(30)]
    (tmp_path / "many.dta").write_text("\n\n".join(texts) + "\n\n\n")
    for i, text in enumerate(texts):
        (tmp_path / f"one{i}.dta").write_text(text + "\n")
    columns = ["mh", "charge", "mz", "scan", "peaks"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        joined = rd.read_dta(spark, str(tmp_path / "many.dta"), joined=True)
        assert joined.rdd.getNumPartitions() > 1
        got = sorted(map(str, joined.select(columns).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 30 and got == sorted(map(str, rd.read_dta(spark, str(tmp_path / "one*.dta")).select(columns).collect()))


def test_joined_peak_files(spark, tmp_path):
    head = "\t".join(f"c{i}" for i in range(13))
    entry = lambda i, n: f"r{i}.2.pkl\t{i}\t0.0\t0\t{n}\t0.0\t950.5\t0.0\t0.0\t+\t0\t0.0\t0.0"
    (tmp_path / "index.txt").write_text("\n".join([head, entry(1, 6), entry(2, 6), entry(3, 2), entry(4, 6)]) + "\n")
    texts = {f"r{i}.2.pkl": "".join(f"\n{100 * i + j}.5\t{j + 1}" for j in range(6)) for i in (1, 2, 3, 9)}
    many, single = tmp_path / "many", tmp_path / "single"
    for folder in (many, single):
        folder.mkdir()
    (many / "part-0").write_text("\n\n".join(name + text for name, text in texts.items()) + "\n\n")
    for name, text in texts.items():
        (single / name).write_text("header" + text + "\n")
    index, columns = str(tmp_path / "index.txt"), ["name", "scan", "charge", "mz", "mh", "peaks"]
    got = [sorted(map(str, rd.read_pkl(spark, index, str(f), joined=j).select(columns).collect())) for f, j in ((many, True), (single, False))]
    assert len(got[0]) == 2 and got[0] == got[1]


def test_spectra_are_dealt_out_before_their_ions(spark, tmp_path):
    from peakloom.plans import bindings
    from peakloom.plans.learning_plans import ml14

    spark.range(3 * bindings.SPECTRA_IN_PART * 4).selectExpr("id as p_partkey", "'hot bolt' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size", "900.0D as p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = ml14(bindings.Tables(spark, str(tmp_path)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # one more than the parts that the rows fill; the window needs no other exchange
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(spectrum_id" in plan and ", 13)" in plan


def test_ions_claim_their_peaks_without_a_window(spark):
    from peakloom.operators import peaks as pk, peptide as pep

    spectra = spark.createDataFrame([(1, "GASPV"), (2, "GG"), (3, "KKKK")], "spectrum_id bigint, peptide string")
    expected = pep.expected_ions(pep.cut_masses(spectra, ["spectrum_id", "peptide"]))
    rng = random.Random(5)
    peaks = spark.createDataFrame([(s, rng.randrange(300_000, 5_500_000), rng.randrange(1, 50)) for s in (1, 3) for _ in range(150)], "spectrum_id bigint, mass_u bigint, intensity bigint")
    found = pk.match_ions(expected, peaks, 30_000)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert len(rows) == expected.filter("spectrum_id <> 2").count()
    claims = [(r.spectrum_id, r.mass_u, r.ion_charge, r.orientation) for r in rows if r.status == "observed"]
    assert len(claims) == len(set(claims)) > 20
    assert sorted(map(tuple, pk.match_ions(expected, peaks, 30_000, observed=True).collect())) == sorted(tuple(r) for r in rows if r.status == "observed")


def test_matches_are_read_once(spark, monkeypatch):
    from peakloom.plans import bindings, stat_plans

    calls, own = [], bindings.Tables.ion_matches
    monkeypatch.setattr(bindings.Tables, "ion_matches", lambda self, *a, **b: calls.append(1) or own(self, *a, **b))
    for run in (stat_plans.agg5, stat_plans.agg32, stat_plans.agg33):
        found = run(bindings.Tables(spark, "/root/testdata/sf0.001"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and found.count()
    assert len(calls) == 3


def test_covered_tags_lay_out_each_text_once(spark):
    from peakloom.operators import peptide as pep

    rng = random.Random(4)
    words = ["".join(rng.choice("AB") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    sets = {s: set(rng.sample(words, 6)) for s in range(50)}
    tags = spark.createDataFrame([(s, w) for s, own in sets.items() for w in sorted(own)] * 2, "set_id bigint, tag string")
    found = pep.drop_covered(tags, "set_id")
    # substrings of the different texts, not of each set
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("set_id" not in line for line in plan.splitlines() if "Generate explode" in line)
    want = sorted((s, w) for s, own in sets.items() for w in own if not any(v != w and v in w for v in own))
    assert sorted(tuple(r) for r in found.collect()) == want


def test_candidate_pairs_shuffle_no_pairs(spark, monkeypatch):
    rng = random.Random(6)
    spectra = [(s, rng.randrange(0, 400), rng.choice([1, 2, None])) for s in range(250)]
    peaks = [(s, rng.randrange(0, 3000) * 40, rng.randrange(1, 30)) for s, _, _ in spectra for _ in range(rng.randrange(1, 9))]
    frames = spark.createDataFrame(spectra, "spectrum_id bigint, mz_u bigint, charge int"), spark.createDataFrame(peaks, "spectrum_id bigint, mass_u bigint, intensity bigint")
    tops = {s: [m for _, m in sorted((-i, m) for q, m, i in peaks if q == s)[:5]] for s, _, _ in spectra}
    want = sorted(
        (a, b) for a, z, c in spectra for b, y, d in spectra
        if a < b and c == d and c and abs(z - y) <= 50 and any(abs(m - n) <= 900 for m in tops[a] for n in tops[b])
    )
    # small units and slices: several parts of a cell, pairs in many turns
    monkeypatch.setattr(sim, "UNIT_WEIGHT", 690)
    monkeypatch.setattr(sim, "PAIRS_AT_ONCE", 16)
    found = sim.candidate_pairs(*frames, 50, 900)
    assert "Aggregate [a#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 200


def test_decoys_are_shuffled_in_one_pass_by_numeric_digests(spark, monkeypatch):
    import hashlib

    from peakloom.operators import peptide as pep

    rng = random.Random(2)
    rows = [(i, f"n{i}", "".join(rng.choice("ACDEK") for _ in range(rng.randrange(0, 300)))) for i in range(40)] + [(None, "x", "AÅB"), (50, None, None), (51, "e", "")]
    monkeypatch.setattr(pep, "LETTERS_AT_ONCE", 500)
    monkeypatch.setattr(pep, "DIGESTS_AT_ONCE", 64)
    assert pep._shuffled(7, [3], ["AB" * 60]) == pep._shuffled(7, [3, 4], ["AB" * 60, "C"])[:1]
    found = pep.decoy_shuffle(spark.createDataFrame(rows, "protein_id bigint, name string, seq string").repartition(3), 7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "Union" not in plan
    digest = lambda i, n: hashlib.md5(":".join(str(x) for x in (7, i, n) if x is not None).encode()).hexdigest()
    plain = lambda i, s: s and "".join(c for _, c in sorted((digest(i, n), c) for n, c in enumerate(s)))
    want = rows + [(i, None if i is None else f"XXX_{i}", plain(i, s)) for i, _, s in rows]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_founders_are_met_without_a_row_for_each_pair(spark, monkeypatch):
    from pyspark.sql import functions as F

    from peakloom.operators import fdr

    rng = random.Random(9)
    score = {i: rng.randrange(6) for i in range(240)}
    times = {(i, f"q{q}"): rng.randrange(1, 4) for i in score for q in rng.sample(range(30), rng.randrange(1, 12))}
    n = {i: sum(t for (j, _), t in times.items() if j == i) for i in score}
    rank = F.struct(F.col("neg"), F.col("id"))
    links = spark.createDataFrame([(i, q, t, n[i], -score[i], i) for (i, q), t in times.items()], "protein_id bigint, peptide string, times bigint, n bigint, neg bigint, id bigint")
    links = links.select("protein_id", "peptide", "times", "n", rank.alias("rank"))
    founded = links.filter("protein_id % 3 = 0").select(F.col("rank").alias("founder_rank"), "peptide")
    want = []
    for i in score:
        shared = [(sum(t for (j, q), t in times.items() if j == i and (f, q) in times), score[f], -f) for f in score if f % 3 == 0 and (-score[f], f) < (-score[i], i)]
        want += [(i, n[i], s, -f, -v) for s, v, f in [max(shared, default=(0, 0, 0))] if s]
    found = [fdr.best_founder(links, founded, pairs=True), fdr.best_founder(links, founded)]
    monkeypatch.setattr(fdr, "LINKS_IN_PART", 400)
    found.append(fdr.best_founder(links, founded, pairs=False))
    assert all(sorted(map(tuple, f.collect())) == sorted(want) for f in found) and len(want) > 200
    assert "Join" not in found[1]._jdf.queryExecution().optimizedPlan().toString().split("CoGroup")[0] and "CoGroup" in found[1]._jdf.queryExecution().optimizedPlan().toString()
    # small tables of pairs, and a part or a block without rows
    own = links.select("protein_id", "peptide", "times", "n", "rank.neg").toArrow()
    others = founded.selectExpr("peptide as held", "founder_rank.neg", "founder_rank.id").toArrow()
    monkeypatch.setattr(fdr, "PAIRS_AT_ONCE", 50)
    assert sorted(tuple(r.values()) for r in fdr._best_in_block(own, others).to_pylist()) == sorted(want)
    assert fdr._best_in_block(own, others.slice(0, 0)).num_rows == fdr._best_in_block(own.slice(0, 0), others).num_rows == 0


def test_proteins_with_the_same_alignments_need_one_decision(spark):
    from peakloom.operators import fdr

    rng = random.Random(3)
    kinds = [rng.sample(range(12), rng.randrange(1, 5)) for _ in range(25)]
    proteins = [(i, rng.randrange(50)) for i in range(500)]
    data = spark.createDataFrame(proteins, "protein_id long, adj_score long"), spark.createDataFrame([(i, q) for i, _ in proteins for q in kinds[i % 25]], "protein_id long, peptide long")
    rounds = []
    got = fdr.protein_groups(*data, hot=2, block=25, rounds=rounds)
    founders, want = [], {}
    for _, i in sorted((-v, i) for i, v in proteins):
        own = set(kinds[i % 25])
        shared = [len(own & set(kinds[f % 25])) for f in founders]
        if max(shared, default=0) * 2 < len(own):
            founders.append(i)
        else:
            want[i] = founders[shared.index(max(shared))]
    # later founders do not take members of earlier ones; a block holds all kinds
    assert sorted(r.protein_id for r in got.filter("is_founder").collect()) == sorted(founders) and len(rounds) == 1
    assert got.count() == 500 and {r.protein_id: r.group_id for r in got.filter("not is_founder").collect()} == want


def test_background_pairs_lay_out_no_probe_for_each_shift(spark):
    from pyspark.sql import functions as F

    from peakloom.operators import peaks as pk

    rng = random.Random(7)
    peaks = spark.createDataFrame([(s, rng.randrange(1, 400) * 5_000, rng.randrange(1, 50)) for s in (1, 2, 3) for _ in range(120)], "spectrum_id bigint, mass_u bigint, intensity bigint")
    sums = spark.createDataFrame([(1, 1_000_000), (2, 2_000_000), (3, 3_500_000), (4, 1)], "spectrum_id bigint, sum_u bigint")
    variants, moves = list(pk.PAIR_VARIANTS), [-220_000, 0, 85_000, 225_000]
    found = pk.complement_totals(peaks, sums, 30_000, variants, moves)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the sums
    shifted = sums.select("spectrum_id", F.explode(F.array(*map(F.lit, moves))).alias("move"), "sum_u").select("spectrum_id", "move", (F.col("sum_u") + F.col("move")).alias("sum_u"))
    pairs = pk.complement_pairs(peaks, shifted, 30_000, variants, ["spectrum_id", "move"])
    want = pairs.groupBy("spectrum_id", "variant").agg(F.count(F.lit(1)), F.sum(F.col("int_a") + F.col("int_b")))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 10
    assert st.background_stats(peaks.limit(0), sums, 20_000, ["single"]).count() == 0


def test_parts_of_a_range_join_follow_the_peaks(spark, monkeypatch):
    from peakloom.plans import bindings
    from peakloom.plans.peak_plans import jn4

    monkeypatch.setattr(bindings, "PEAKS_IN_PART", 250)
    plan = jn4(bindings.Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2 and ", 25)" in plan


def test_shared_cuts_are_counted_without_a_lambda_for_each_row(spark):
    from pyspark.sql import functions as F

    from peakloom.operators import peptide as pep, solutions as sol

    rng = random.Random(1)
    rows = [tuple("".join(rng.choice("GASPVBK") for _ in range(rng.randrange(0, 9))) for _ in range(2)) for _ in range(300)] + [(None, "G"), ("G", None), ("", "")]
    pairs = spark.createDataFrame(rows, "a string, b string")
    found = sol.with_shared_cuts(pairs, "a", "b", 30_000)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    near = F.filter(pep.prefix_mass_array(F.col("a")), lambda x: F.exists(pep.prefix_mass_array(F.col("b")), lambda y: F.abs(x - y) <= 30_000))
    want = pairs.select("a", "b", (F.size(near) / F.size(pep.prefix_mass_array(F.col("a")))).alias("share"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    hits = spark.createDataFrame([(1, "GAS", 9), (1, "GAP", 5), (1, "KK", 3), (2, "V", 4)], "spectrum_id bigint, seq string, score bigint")
    again = sol.recalibrate_hits(hits, 5_000, 0.6)
    assert [tuple(r) for r in again.orderBy("spectrum_id", "rank").collect()] == [(1, "GAS", 9, 1, 4, 6), (1, "GAP", 5, 2, -4, None), (1, "KK", 3, 3, -6, None), (2, "V", 4, 1, 4, 4)]
    assert again._jdf.queryExecution().optimizedPlan().toString().count("max(score") == 1


def test_parts_of_graph_nodes_follow_the_peaks(spark, monkeypatch):
    import re

    from peakloom.plans import bindings
    from peakloom.plans.stat_plans import true_nodes

    monkeypatch.setattr(bindings, "PEAKS_IN_PART", 250)
    plan = true_nodes(bindings.Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    # all else that is shuffled by a spectrum is a mass range of each or the table of spectra
    ranges = re.findall(r"Exchange hashpartitioning\(spectrum_id.*?ENSURE_REQUIREMENTS", plan)
    assert plan.count(", 25), REPARTITION_BY_NUM") == 6 and len(ranges) <= 1 and "run#" not in "".join(ranges)


def test_match_within_a_tolerance_lays_out_no_pair(spark):
    from peakloom.functions.band import with_match

    rng = random.Random(8)
    rows = [(rng.randrange(4), rng.randrange(5000), i) for i in range(300)] + [(9, 10, 300), (0, 77, 301), (0, 77, 301)]
    points = [(rng.randrange(4), rng.randrange(5000)) for _ in range(60)] + [(0, 92), (8, 5)]
    left, right = spark.createDataFrame(rows, "k int, at bigint, n int"), spark.createDataFrame(points, "k int, at bigint")
    want = sorted((k, a, n, any(k == q and abs(a - p) <= 15 for q, p in points)) for k, a, n in rows)
    for spread, parts in ((1, None), (32, 5)):
        found = with_match(left, right, "k", "at", 15, "hit", spread, parts)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, found.collect())) == want
    assert [tuple(r) for r in with_match(left.limit(1), right.limit(0), "k", "at", 15, "hit").select("hit").collect()] == [(False,)]


def test_sums_of_runs_need_no_run_of_each_point(spark):
    from pyspark.sql import functions as F

    from peakloom.operators import peaks as pk

    rng = random.Random(4)
    df = spark.createDataFrame([(rng.randrange(3), rng.randrange(900), rng.randrange(9)) for _ in range(200)] + [(7, 3, 1)], "k int, x bigint, v bigint")
    for gap in (0, 3, 10):
        want = pk.sessionize(df, ["k"], "x", gap).groupBy("k", "run").agg(F.sum("v"), F.sum("x"))
        found = pk.run_sums(df, ["k"], "x", gap, {"v": F.col("v"), "x": F.col("x")})
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def similar_frames(spark, n=200):
    rng = random.Random(21)
    lists = {s: {rng.randrange(0, 2000) * 40: rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))} for s in range(n)}
    lists |= {n + s: lists[s] for s in range(0, n, 5)}  # copies
    place = {s: (rng.randrange(0, 300), rng.choice([1, 2])) for s in range(n)}
    spectra = spark.createDataFrame([(s, *place[s % n if s < n else s - n]) for s in lists], "spectrum_id bigint, mz_u bigint, charge int")
    peaks = spark.createDataFrame([(s, m, i) for s, p in lists.items() for m, i in p.items()], "spectrum_id bigint, mass_u bigint, intensity bigint")
    return spectra, peaks


def test_representatives_need_no_second_search_of_pairs(spark, monkeypatch):
    """Similarity sums come with the links, whatever the units and slices are, and equal those over all pairs."""
    spectra, peaks = similar_frames(spark)
    copies = sim.fold_copies(spectra, peaks)
    pairs = sim.similar_pairs(spectra, peaks, 50, 900, 700, 0.3)
    want = sorted(tuple(r) for r in sim.representatives(sim.clusters(pairs), pairs, copies).collect())
    assert len(want) > 5 and max(r[2] for r in want) > 3_000_000
    for weight, most in ((1 << 21, 10_000), (300, 10_000), (300, 8)):
        monkeypatch.setattr(sim, "UNIT_WEIGHT", weight)
        monkeypatch.setattr(sim, "SEEN_AT_ONCE", weight)
        scored = sim.scored_pairs
        monkeypatch.setattr(sim, "scored_pairs", lambda *a, **k: scored(*a, **k, most_peaks=most))
        found = sim.similar_pairs(spectra, peaks, 50, 900, 700, 0.3, True, copies).cache()
        monkeypatch.setattr(sim, "scored_pairs", scored)
        assert sorted(tuple(r) for r in sim.representatives(sim.clusters(found), found, copies).collect()) == want
        assert weight == 300 or found.filter("b is not null").count() < pairs.count()
        found.unpersist()


def test_a_spectrum_goes_to_two_units_while_its_cell_is_one_part(spark):
    from pyspark.sql import functions as F

    rows = [(s, s % 2000, 1, 30) for s in range(8000)]
    placed = sim._placed(spark.createDataFrame(rows, "spectrum_id bigint, mz_u bigint, charge int, n int"), 50).join(spark.createDataFrame([(s, 30) for s, *_ in rows], "spectrum_id bigint, n int"), "spectrum_id")
    laid = sim._laid(placed, F.col("n") * 40)  # 240,000 a cell: two parts as they were
    assert laid.count() <= 2 * len(rows)
    pairs = laid.select("spectrum_id", "unit.*").groupBy("at", "kind", "i", "j").agg(F.count("*").alias("n"))
    assert pairs.filter("kind = 1").count() == 39 and pairs.filter("kind = 0").count() == 1


def test_forest_scores_no_pair_that_is_joined(monkeypatch):
    import pyarrow as pa

    n, scored, plain = 300, [], sim._Lists.matched
    monkeypatch.setattr(sim._Lists, "matched", lambda self, a, b, tol: scored.append(len(a)) or plain(self, a, b, tol))
    p = pa.array([[{"mass_u": 1000 + i, "intensity": 5}, {"mass_u": 5000, "intensity": 9}] for i in range(n)], pa.list_(pa.struct({"mass_u": pa.int64(), "intensity": pa.int64()})))
    one = {"spectrum_id": pa.array(range(n)), "mz_u": pa.array([7] * n), "p": p, "side": pa.array([0] * n, pa.int32()), "inner": pa.array([True] * n)}
    batch = pa.RecordBatch.from_pydict(one)
    links = sum(len(b) for b in sim._scored_unit(50, 400, 300, 0.2, True, False)(iter([batch])))
    first = sum(scored)
    whole = sum(len(b) for b in sim._scored_unit(50, 400, 300, 0.2, False, False)(iter([batch])))
    assert links == n - 1 and whole == n * (n - 1) // 2 == sum(scored) - first
    assert first < whole / 10


def test_complement_pairs_shuffle_no_probes(spark):
    from peakloom.functions import mass
    from peakloom.operators import peaks as pk

    rng = random.Random(14)
    rows = [(s, rng.randrange(0, 2000) * 1000, rng.randrange(1, 50)) for s in range(6) for _ in range(60)] + [(None, 5, 1), (1, None, 2)]
    sums = [(s, move, 1_900_000 + 40_000 * s + move) for s in range(6) for move in (0, 7000)] + [(2, 3, None)]
    peaks = spark.createDataFrame(rows, "spectrum_id bigint, mass_u bigint, intensity bigint")
    given = spark.createDataFrame(sums, "spectrum_id bigint, move int, sum_u bigint")
    found = pk.complement_pairs(peaks, given, 3_000, list(pk.PAIR_VARIANTS), ["spectrum_id", "move"])
    want = []
    for s, move, total in sums:
        own = [(m, i) for q, m, i in rows if q == s and m is not None and total is not None]
        for name, (k, p, w, i) in pk.PAIR_VARIANTS.items():
            for a, ia in own:
                wanted = (total or 0) + p * mass.PROTON - w * mass.WATER + i * mass.ISOTOPE_STEP - k * a
                want += [(s, move, name, a, b, ia, ib, b - wanted) for b, ib in own if abs(b - wanted) <= 3_000 and (a < b if k == 1 else a != b)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 300
    # neither a row for each variant nor buckets of intervals
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert " _b#" not in plan and "[_b#" not in plan and "single_water" not in plan.split("MapInArrow")[-1]
    stats = pk.complement_stats(found, ["spectrum_id", "move"])
    assert stats._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 1
    assert sum(r.n_pairs for r in stats.collect()) == len(want)


def test_substrings_of_a_mass_make_no_row_for_each_start(spark, monkeypatch):
    from peakloom.functions import mass
    from peakloom.operators import peptide as pep

    monkeypatch.setattr(pep, "LETTERS_AT_ONCE", 100)
    rng = random.Random(15)
    rows = [(i, "".join(rng.choice("GASPVTXé\n𝄞") for _ in range(rng.randrange(0, 90)))) for i in range(40)] + [(90, None), (91, ""), (92, "GG"), (93, "G")]
    target, tol = 2 * mass.RESIDUE_MASS["G"], 150_000
    want = []
    for name, seq in rows:
        for i in range(len(seq or "")):
            total, j = 0, i
            while j < len(seq) and total < target - tol:
                total, j = total + mass.RESIDUE_MASS.get(seq[j], 10**12), j + 1
            if target - tol <= total <= target + tol:
                want.append((name, i, seq[i:j], total))
    found = pep.candidates_with_mass(spark.createDataFrame(rows, "protein_id bigint, seq string").repartition(2), target, tol)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 20
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_of_candidate_masses_are_merged_where_the_peaks_are(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(16)
    strong = spark.createDataFrame([(s, rng.randrange(400_000, 9_000_000), rng.randrange(1, 50)) for s in range(5) for _ in range(60)], "own bigint, mass_u bigint, intensity bigint").distinct()
    graphs = spark.createDataFrame([(s, s * 16 + i, 9_500_000 + 10_033 * i) for s in range(5) for i in range(3)], "own bigint, spectrum_id bigint, pm_u bigint")
    laid = strong.join(graphs, "own").select("spectrum_id", "mass_u", "intensity")
    plain = graph.merge_close_nodes(graph.fragment_nodes(laid, graphs), 50_000)
    plans, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    found = graph.merge_close_nodes(graph.fragment_nodes(strong, graphs, 3, "own"), 50_000, by="own")
    for a, b in zip(found, plain):
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    # one table is stored; besides the two that are joined nothing is shuffled
    assert len(plans) == 1 and sum("REPARTITION_BY_NUM" in line for line in plans[0].splitlines()) == 2 and plans[0].count("SortMergeJoin") == 1
    assert plans[0].split("SortMergeJoin")[0].count("Exchange") == 0
    barred = graph.forbidden_pairs(found[1], 5_000)
    b, y = (found[1].filter(F.col("ion") == i).select("spectrum_id", "peak_u", "pm_u", F.col("mass_u").alias(i)) for i in "by")
    want = b.join(y.drop("pm_u"), ["spectrum_id", "peak_u"]).filter("b <> y and abs(b + y - pm_u + 10073) <= 7500").selectExpr("spectrum_id", "least(b, y)", "greatest(b, y)").distinct()
    assert sorted(map(tuple, barred.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10
