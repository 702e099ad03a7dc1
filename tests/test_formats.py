"""Readers on hand-written files."""

import base64
import struct

from peakloom.sources import readers as rd


def test_mgf(spark, tmp_path):
    (tmp_path / "a.mgf").write_text(
        "BEGIN IONS\nTITLE=run.12.12.2.dta\nCHARGE=2+\nPEPMASS=500.5 12.0\nRTINSECONDS=33.5\nPEPSEQ=PEPTIDE\n"
        "300.1 5\n100.5 0\n-3 4\n200.2 7.5\nEND IONS\n\nBEGIN IONS\nTITLE=other\nSCANS=9\nPEPMASS=400.25\n150.0 1\nEND IONS\n"
    )
    got = {r["scan"]: r for r in rd.read_mgf(spark, str(tmp_path / "a.mgf")).collect()}
    assert set(got) == {12, 9}
    a, b = got[12], got[9]
    assert (a["charge"], a["mz"], a["rt_s"], a["peptide"]) == (2, 500.5, 33.5, "PEPTIDE")
    assert [(p["mass"], p["intensity"]) for p in a["peaks"]] == [(100.5, 1e-9), (200.2, 7.5), (300.1, 5.0)]
    assert b["charge"] is None and b["mh"] is None and len(b["peaks"]) == 1


def test_dta(spark, tmp_path):
    (tmp_path / "a.dta").write_text("# comment\n1000.5 2\tscan=7\n# more\n" + "\n".join(f"{100 + i}.5 {i}" for i in range(1, 7)))
    r = rd.read_dta(spark, str(tmp_path / "a.dta")).first()
    assert (r["mh"], r["charge"], r["scan"], len(r["peaks"])) == (1000.5, 2, 7, 6)
    assert abs(r["mz"] - (1000.5 + 1.00728) / 2) < 1e-9


def test_mzxml_with_nested_scan(spark, tmp_path):
    def scan(num, level, order, inner=""):
        fmt = ">" if order == "network" else "<"
        vals = [v for i in range(8) for v in (100.0 + i, 1.0 + i)]
        b64 = base64.b64encode(struct.pack(f"{fmt}16f", *vals)).decode()
        return (
            f'<scan num="{num}" msLevel="{level}" peaksCount="8" retentionTime="PT{num}.5S"><precursorMz precursorIntensity="3.0" precursorCharge="2">500.25</precursorMz>'
            f'<peaks precision="32" byteOrder="{order}">{b64}</peaks>{inner}</scan>'
        )

    body = scan(1, 1, "network", scan(2, 2, "network")) + scan(3, 2, "little")
    (tmp_path / "a.mzxml").write_text(f"<?xml version='1.0'?>\n<mzXML><msRun>{body}</msRun></mzXML>")
    got = {r["scan"]: r for r in rd.read_mzxml(spark, str(tmp_path / "a.mzxml")).collect()}
    assert set(got) == {2, 3}
    for r in got.values():
        assert [(p["mass"], p["intensity"]) for p in r["peaks"]] == [(100.0 + i, 1.0 + i) for i in range(8)]
        assert (r["mz"], r["charge"]) == (500.25, 2)


def test_mzxml_deeper_and_wider(spark, tmp_path):
    def scan(num, inner="", bits=32):
        vals = [v for i in range(8) for v in (100.0 + i, 1.0 + i)]
        b64 = base64.b64encode(struct.pack(f">16{'f' if bits == 32 else 'd'}", *vals)).decode()
        return f'<scan num="{num}" msLevel="2" peaksCount="8"><precursorMz precursorCharge="2">500.25</precursorMz><peaks precision="{bits}" byteOrder="network">{b64}</peaks>{inner}</scan>'

    for i in range(2):
        (tmp_path / f"{i}.mzxml").write_text(f"<mzXML><msRun>{scan(1 + 10 * i, scan(2 + 10 * i, scan(3 + 10 * i, scan(4 + 10 * i, bits=64))))}</msRun></mzXML>")
    got = rd.read_mzxml(spark, str(tmp_path)).collect()
    assert sorted(r["scan"] for r in got) == [1, 2, 3, 4, 11, 12, 13, 14]
    assert all([(p["mass"], p["intensity"]) for p in r["peaks"]] == [(100.0 + i, 1.0 + i) for i in range(8)] for r in got)


def test_mixed_path_list_with_equal_names(spark, tmp_path):
    for d in "xy":
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.fasta").write_text(f">{d}1\nKK\n>{d}2\nGG\n")
        (tmp_path / d / "a b.mgf").write_text(f"BEGIN IONS\nTITLE={d}\nSCANS=3\nPEPMASS=400.25\n150.0 1\nEND IONS\n")
    names = ["y/a.fasta", "x/a b.mgf", "x/a.fasta", "y/a b.mgf"]
    (tmp_path / "list").write_text("\n".join(f"{tmp_path}/{n}" for n in names))
    got = sorted((r["file_idx"], r["name"] or r["title"]) for r in rd.read_path_list(spark, str(tmp_path / "list")).collect())
    assert got == [(0, "y1"), (0, "y2"), (1, "x"), (2, "x1"), (2, "x2"), (3, "y")]


def test_fasta_and_path_list(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one\nPEPT\nIDEZ\n>two\nacGH\n>empty\n")
    (tmp_path / "b.fasta").write_text(">three\nKKK\n")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.fasta\n{tmp_path}/b.fasta\n")
    got = {r["name"]: (r["seq"], r["file_idx"]) for r in rd.read_path_list(spark, str(tmp_path / "list.txt"), rd.read_fasta).collect()}
    assert got == {"one": ("PEPTIDE", 0), "two": ("GH", 0), "empty": ("", 0), "three": ("KKK", 1)}


def test_pkl(spark, tmp_path):
    (tmp_path / "peaks").mkdir()
    (tmp_path / "peaks" / "s1.2.pkl").write_text("head\n" + "\n".join(f"{100 + i}\t{i}" for i in range(7)))
    cols = "name scan rt np n mz_sel mz mz_cen mh z ns mi pi".replace(" ", "\t")
    row = lambda n, k, mz: f"{n}\t5\t1.5\t9\t{k}\t0\t{mz}\t0\t0\tx\t1\t2.0\t3.0"
    (tmp_path / "idx.tsv").write_text("\n".join([cols, row("s1.2.pkl", 7, 500.5), row("s2.2.pkl", 5, 500.5), row("s3.2.pkl", 9, 5000)]))
    got = rd.read_pkl(spark, str(tmp_path / "idx.tsv"), str(tmp_path / "peaks"), 100, 2000).collect()
    assert [(r["name"], r["charge"], len(r["peaks"])) for r in got] == [("s1.2.pkl", 2, 7)]


def test_blast_report(spark, tmp_path):
    def hit(score, pep):
        return f" Score = {score} (20.1 bits)\n Identities = 5/6\n\nQuery: 1  {pep} 6\n          x\nSbjct: 3  {pep[::-1]} 9\n\n"

    text = "intro\nSequences producing High-scoring Segment Pairs\n\n>P1|alpha\n   Length = 90\n\n" + hit(55, "PEPTIDE") + hit(44, "KLMNPQ")
    text += ">XXX_0 decoy\n   Length = 80\n\n" + hit(30, "AAAGGG")
    (tmp_path / "a.blast").write_text(text)
    got = sorted((r["protein"], r["is_decoy"], r["score"], r["peptide"], r["subject"]) for r in rd.read_blast_report(spark, str(tmp_path / "a.blast")).collect())
    assert got == [
        ("P1|alpha", False, 44, "KLMNPQ", "QPNMLK"),
        ("P1|alpha", False, 55, "PEPTIDE", "EDITPEP"),
        ("XXX_0 decoy", True, 30, "AAAGGG", "GGGAAA"),
    ]


def test_search_hits_ranges(spark, tmp_path):
    good = "f 7 K.PEP.T prot 2 1.5 7 1 1 0.5 0.5 10 2 0.1 1 1 1 1 1 1".split()
    bad = list(good)
    bad[12] = "9"
    (tmp_path / "h.tsv").write_text("\n".join("\t".join(x) for x in (good, bad)))
    got = [r["valid"] for r in rd.read_search_hits(spark, str(tmp_path / "h.tsv")).orderBy("ntt").collect()]
    assert got == [True, False]


def test_pkl_indexes_with_equal_names(spark, tmp_path):
    head = "name\tscan\trt\tnp\tpeaks\tmz_sel\tmz\tmz_cen\tmh\tz\tns\tmax\tpre\n"
    for folder, base in (("one", 100), ("two", 200)):
        (tmp_path / folder).mkdir()
        entries = [("s.2.pkl", 1, 8, 500.5), ("few.2.pkl", 2, 5, 500.5), ("far.2.pkl", 3, 8, 5000.0), ("missing.3.pkl", 4, 8, 500.5)]
        lines = [f"{n}\t{base + s}\t1.5\t0\t{k}\t0\t{mz}\t0\t0\t+\t0\t9.0\t7.5\n" for n, s, k, mz in entries]
        (tmp_path / folder / "index.txt").write_text(head + "".join(lines))
        for name in ("s.2.pkl", "few.2.pkl", "far.2.pkl", "stray.1.pkl"):
            (tmp_path / folder / name).write_text("777 1\n" + "".join(f"{base + i}.25 {i}\n" for i in range(1, 9)))
    paths = [str(tmp_path / f / "index.txt") for f in ("one", "two")]
    got = sorted((r.scan, r.charge, r.mz, r.peaks[0].mass, len(r.peaks)) for r in rd.read_pkl(spark, paths, max_mz=1000.0).collect())
    assert got == [(101, 2, 500.5, 101.25, 8), (201, 2, 500.5, 201.25, 8)]
    (tmp_path / "list").write_text("\n".join(reversed(paths)))
    listed = rd.read_path_list(spark, str(tmp_path / "list"))
    assert sorted((r.file_idx, r.scan) for r in listed.collect()) == [(0, 201), (0, 203), (1, 101), (1, 103)]


def test_modification_rules(spark, tmp_path):
    import pytest

    from peakloom.functions import mass
    from peakloom.operators import modifications as mods

    path = tmp_path / "rules"
    path.write_text(
        "# comment line with six fields\nC 57.021464 FIXED ALL C+57 Carbamido methyl\nC -57.021 OPTIONAL ALL C-57 Loss\nM 15.994915 OPTIONAL ALL M+16 Oxidation\n"
        "N_TERM 42.010565 OPTIONAL N_TERM ^+42 Acetyl\nC_TERM -0.984016 OPTIONAL C_TERM $-1 Amide\nQ -17.026549 FIXED N_TERM Q-17 Pyro\nK 8.0142 OPTIONAL -1 K+8 Heavy\nW 12.0 FIXED 3 W+12 Bad\n\nshort line\n"
    )
    rules = rd.read_modifications(spark, str(path))
    assert rules.count() == 8
    g, c, m, q, k = (mass.RESIDUE_MASS[r] for r in "GCMQK")
    cases = {
        "GC": g + c + 570_215, "GC-57": g + c + 570_215 - 570_210, "GM+16": g + m + 159_949, "^+42G": g + 420_106, "G^+42": None, "G$-1": g - 9_840, "$-1G": None,
        "Q-17G": q + g - 170_265, "GQ-17": None, "GK+8": g + k + 80_142, "K+8G": None, "GW+12": None, "Gx": None, "": 0, None: 0, "[12]G": g, "^+42$-1": 420_106 - 9_840,
    }
    chosen = mods.chosen_rules(rules, "C+57:C-57:M+16:^+42:$-1:Q-17:K+8")
    df = spark.createDataFrame(list(enumerate(cases)), "id int, peptide string")
    got = {r.id: (r.mass_u, r.valid) for r in mods.masses_by_rules(df, ["id"], chosen).collect()}
    assert got == {i: (v, v is not None) for i, v in enumerate(cases.values())}
    with pytest.raises(Exception, match="must hold everywhere"):
        mods.chosen_rules(rules, "W+12")
    with pytest.raises(ValueError, match="no rule for H\\+57"):
        mods.chosen_rules(rules, "H+57:M+16")
    path.write_text("B 1.0 OPTIONAL ALL B+1 Unknown\n")
    with pytest.raises(Exception, match="unknown residue or place"):
        rd.read_modifications(spark, str(path)).collect()


def test_gap_shares():
    import itertools

    from peakloom.functions import mass
    from peakloom.operators import peptide as pep

    table = {(at, g): share for at, g, share in pep.gap_shares()}
    assert all(abs(sum(table.get((at, g), 0) for g in range(1, 8)) - 1) < 1e-9 for at in {at for at, _ in table})
    at = (2 * (mass.RESIDUE_MASS["G"] + mass.RESIDUE_MASS["A"]) + 5_000) // 10_000
    letters = list(mass.RESIDUE_MASS.values())
    part = [sum(abs((2 * sum(c) + 5_000) // 10_000 - at) <= 1 for c in itertools.product(letters, repeat=g)) / 20**g for g in (1, 2, 3)]
    assert all(abs(table.get((at, g), 0) - part[g - 1] / sum(part)) < 1e-9 for g in (1, 2, 3))
