"""Counts around each peak: brute force, chunk edges and cost in a dense chunk."""

import random
import time

import numpy as np

from peakloom.functions import band
from peakloom.operators import peaks as pk
from test_units import rows


def test_larger_in_ranges():
    rng = np.random.default_rng(1)
    for n, levels in ((1, 1), (2, 1), (50, 4), (300, 1000)):
        v = rng.integers(0, levels, n)
        a = rng.integers(0, n, n)
        b = np.minimum(a + rng.integers(0, n, n), n)
        assert band.larger_in_ranges(v, a, b).tolist() == [int((v[i:j] > x).sum()) for i, j, x in zip(a, b, v)]


def test_counts_over_chunk_edges(spark):
    rnd = random.Random(5)
    data = [(1 if i % 3 == 0 else rnd.randrange(2, 9), rnd.randrange(0, 40_000), rnd.randrange(1, 9), f"p{i}") for i in range(900)]
    df = spark.createDataFrame(data, "spectrum_id long, mass_u long, intensity long, name string").repartition(5)
    got = rows(pk.stronger_in_window(df, 1_000, {"before": (-700, -300)}))
    want = []
    for s, m, i, name in data:
        near = [(mm, ii) for ss, mm, ii, _ in data if ss == s and abs(mm - m) <= 1_000]
        want.append((s, m, i, name, sum(ii > i for _, ii in near), len(near), sum(m - 700 <= mm <= m - 300 for mm, _ in near)))
    assert got == sorted(want)
    assert pk.stronger_in_window(df.limit(0), 1_000).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(pk.stronger_in_window(df, 1_000, {"before": (-700, -300)})) == got
        # a window smaller than the isotope step looks for parents in a wider one
        assert rows(pk.strong_peaks(df, 1_000, 3, 5_000)) == sorted(
            (s, m, i) for s, m, i, _ in data
            if sum(ss == s and abs(mm - m) <= 500 and ii > i for ss, mm, ii, _ in data) < 3 and not any(ss == s and 7_533 <= m - mm <= 12_533 for ss, mm, _, _ in data)
        )
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_dense_chunk_costs_in_proportion(spark):
    def seconds(n):
        df = spark.range(n).selectExpr("1L as spectrum_id", "id * 7 % 1000000 as mass_u", "id * 31 % 997 as intensity").coalesce(1)
        best = []
        for _ in range(2):
            start = time.time()
            pk.stronger_in_window(df, 1_000_000).write.format("noop").mode("overwrite").save()
            best.append(time.time() - start)
        return min(best)

    seconds(1000)
    small, large = seconds(8_000), seconds(64_000)
    assert large < 8 * small + 1


def test_range_maximum():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 100):
        v = rng.integers(0, 5, n)
        a = rng.integers(0, n + 1, 200)
        b = np.minimum(a + rng.integers(0, n + 1, 200), n)
        assert band.RangeMax(v).at(a, b).tolist() == [int(i + v[i:j].argmax()) if j > i else -1 for i, j in zip(a, b)]


def test_edges_equal_all_pairs(spark):
    from peakloom.functions import mass

    rnd = random.Random(7)
    data = [(1 if i % 3 == 0 else rnd.randrange(2, 9), rnd.randrange(0, 5_000_000), rnd.randrange(5)) for i in range(700)]
    df = spark.createDataFrame(data, "spectrum_id long, mass_u long, score long").repartition(4)
    tol, want = 5_000, set()
    for s, m, _ in data:
        ahead = [(t, sc) for k, t, sc in data if k == s and t > m]
        single = set()
        for label, n, step in pk.residue_steps(True):
            if n == 2 and single & set(label):
                continue
            fits = [(abs(t - m - step) > tol // 2, -sc, t) for t, sc in ahead if abs(t - m - step) <= tol * 3 // 2]
            if fits:
                _, sc, t = min(fits)
                want.add((s, m, t, label, n, t - m - step, -sc))
                single |= {label} - set(pk.SHARED_RESIDUES) if n == 1 else set()
    got = rows(pk.mass_difference_edges(df, tol, doubles=True))
    assert sorted(set(got)) == sorted(want) and len(want) > 1000
    assert rows(pk.mass_difference_edges(df, tol)) == sorted(e for e in got if e[4] == 1)
    near = {(s, m, a) for s, m, _ in data for k, t, _ in data if k == s for a, r in mass.EDGE_RESIDUES.items() if abs(abs(t - m) - r) <= tol}
    assert {(r[0], r[1], r[2]) for r in rows(pk.ladder_edges(df, tol))} == near
