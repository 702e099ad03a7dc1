"""Mixing, whitening and spelling variants against brute-force versions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import mixing, queries, spelling, whitening
from peakloom.llm.common import table

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11: mixing ---------------------------------------------------------------------------


def plain_targets(sizes, total, weights=(1, 2, 3), most=3):
    """Deal by weight, stop sources at their cap, deal the excess again."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    capped = {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in sizes}
        capped |= {s: most * sizes[s] for s in over}


def mix_docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "é", "Z", ""])) for i in range(600)]
    rows += [(7, "same text here", "hot")] * 900 + [(None, None, None), (None, "x y", None), (5, "", "empty"), (6, None, "empty"), (9, "one " * 30_000, "long")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as src", "2 as key", "3 as size").repartition(5)


@pytest.mark.parametrize("last_rows", [4096, 3])
def test_mix(spark, monkeypatch, last_rows):
    monkeypatch.setattr(mixing, "LAST_ROWS", last_rows)
    docs = mix_docs(spark)
    out = mixing.mix_documents(docs, shares=(0.1, 0.5, 1.0, 2.5)).collect()
    assert len(out) == docs.count()
    sizes, longest = collections.Counter(), collections.Counter()
    for r in out:
        sizes[r.source] += r.size
        longest[r.source] = max(longest[r.source], r.size)
    assert sizes["hot"] == 2700 and sizes["empty"] == 0 and sizes["long"] == 30_000
    for i, share in enumerate((0.1, 0.5, 1.0, 2.5)):
        target = plain_targets(sizes, round(share * sum(sizes.values())))
        taken = collections.Counter()
        for r in out:
            m = r.mixes[i]
            taken[r.source] += m.taken
            assert m.taken == r.size * m.copies and 0 <= m.copies <= 3 and r.source_size == sizes[r.source]
            assert m.target == pytest.approx(target[r.source])
            assert i == 0 or m.copies >= r.mixes[i - 1].copies
        for s in sizes:
            assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1


def test_mix_is_repeated_and_written(spark):
    docs = mix_docs(spark)
    pick = lambda d: sorted(map(str, d.select("doc_id", "size", F.col("mixes")[0].taken).collect()))
    assert pick(mixing.mix_documents(docs)) == pick(mixing.mix_documents(docs.repartition(11)))
    want = collections.Counter()
    for r in mixing.mix_documents(docs).collect():
        want[r.doc_id, r.source, r.size] += r.mixes[0].copies
    got = collections.Counter()
    mix = mixing.mixed_rows(docs)
    assert mix.columns == docs.columns
    for r in mix.collect():
        got[r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))] += 1
    assert got == +want


def test_mix_nothing(spark, awkward, nothing):
    assert mixing.mix_documents(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0
    out = mixing.mix_documents(awkward).collect()
    assert len(out) == awkward.count() and {r.size for r in out if r.doc_id in (3, 4, 9)} == {0}
    with pytest.raises(ValueError):
        mixing.mix_documents(nothing, weights=(0, 1))


# --- 12: whitening ------------------------------------------------------------------------


def plain_whitened(vectors, k=4):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(e), e / (centred**2).sum() * n


def same_up_to_sign(a, b):
    return all(min(np.abs(a[:, i] - b[:, i]).max(), np.abs(a[:, i] + b[:, i]).max()) < 1e-9 for i in range(a.shape[1]))


@pytest.mark.parametrize("block_bytes, columns", [(1 << 20, 1024), (2048, 5)])
def test_whitening(spark, monkeypatch, block_bytes, columns):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", columns)
    rng = np.random.default_rng(4)
    good = [[float(c) for c in v] for v in rng.normal(0, 0.2, (300, 12)) * np.arange(1, 13)]
    good += [good[0]] * 2500 + [[c + 1e-9 for c in good[1]]]
    bad = [None, [None] + [0.1] * 11, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [-float("inf")] * 12]
    rows = [(i, v, 1, 2) for i, v in enumerate(good)] + [(-1, v, 1, 2) for v in bad] + [(None, good[5], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int, n int").repartition(6)
    out, model = whitening.whiten(df)
    got = {r.id: r for r in out.collect()}
    assert out.count() == len(good) + 1 and -1 not in got
    n, deviation, white, share = plain_whitened(good)
    assert model["n"] == n == got[0].n and [int(got[i].deviation) for i in range(len(good))] == deviation.tolist()
    assert same_up_to_sign(np.array([got[i].whitened for i in range(len(good))]), white)
    assert np.allclose(model["explained"], share) and model["identity_error"] < 1e-9 and got[None].whitened == got[5].whitened


def test_whitening_query(spark):
    rows = queries.op12_whitening(spark, SMALL).toPandas()
    given = table(spark, SMALL, "embeddings").toPandas()
    n, deviation, white, share = plain_whitened(given.embedding)
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[given.vec_id]
    assert same_up_to_sign(wide.to_numpy(), white) and (rows.n == n).all() and (rows.identity_error < 1e-9).all()
    assert (rows[rows.component == 1].set_index("vec_id").loc[given.vec_id].deviation.to_numpy() == deviation).all()
    assert np.allclose(rows.groupby("component").explained.first(), share)


def test_whitening_without_directions(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty)[0].count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], empty.schema)
    assert sorted((r.id, int(r.deviation), r.whitened) for r in whitening.whiten(same)[0].collect()) == [(1, 0, []), (2, 0, [])]
    # one direction only; a short vector is filled up with zeros; an entry beyond a long does no harm
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, []), (4, [3.0, 0.0])], empty.schema)
    assert all(len(r.whitened) == 1 for r in whitening.whiten(ragged)[0].collect())
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [2.0, 1.0])], empty.schema)
    assert whitening.whiten(huge)[0].count() == 2


# --- 13: spelling -------------------------------------------------------------------------


def plain_words(docs):
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_forms(words):
    holes, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)  # equal but for the letter at i
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        if near[w] and (best := min(near[w], key=lambda v: (-words[v], v))) and words[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def forms_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_spelling_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    want = plain_forms(plain_words(docs))
    assert len(want) > 500 and sum(r[1] is not None for r in want) > 100
    assert forms_of(queries.op13_spelling(spark, SMALL)) == want


@pytest.mark.parametrize("filter_bytes", [1 << 24, 256])
def test_spelling_families(spark, filter_bytes):
    rng = random.Random(8)
    letters, docs = "aabbcéÿZ", []
    for i in range(300):
        base = "".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 6, 7, 48, 49, 100])))
        words = [base] * rng.randint(1, 40)
        for _ in range(4):
            at, c = rng.randrange(len(base)), rng.choice(letters)
            words += [rng.choice([base[:at] + base[at + 1 :], base[:at] + c + base[at:], base[:at] + c + base[at + 1 :]])] * rng.randint(1, 9)
        docs.append((rng.choice([i, i, None]), " ".join(words)))
    docs += [(1, "hotword " * 4000), (2, None), (3, ""), (4, "x" * 50_000 + " " + "x" * 50_000 + " " + "x" * 50_000), (5, ("x" * 49_999 + " ") * 3)] + [(6, "hotwerd hotwird")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' as word", "1 as n").repartition(4)
    assert forms_of(spelling.spelling_forms(df, filter_bytes=filter_bytes)) == plain_forms(plain_words(docs))
    assert filter_bytes > 256 or len(spelling.plan_passes({5: 100, 6: 900}, filter_bytes)) > 8


def test_spelling_nothing(spark, nothing):
    assert spelling.spelling_forms(nothing).count() == 0
