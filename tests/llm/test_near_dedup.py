"""The near-duplicate stage against brute-force shingle similarity."""

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from peakloom.llm import near_dedup
from peakloom.llm.common import table
from test_corpus import texts_of


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return out


def plain_kept(docs):
    """Rows that stay, by exact similarities of all pairs that share a shingle; ``docs`` come in order of their ids."""
    sets, where, label = plain_sets([t for _, t in docs]), collections.defaultdict(list), np.arange(len(docs))
    for n, own in enumerate(sets):
        shared = collections.Counter(m for s in own for m in where[s])
        for s in own:
            where[s].append(n)
        for m, k in shared.items():
            if 5 * k >= 4 * (len(own) + len(sets[m]) - k):
                low, high = sorted((label[n], label[m]))
                label[label == high] = low
    return sorted(docs[n][0] for n in set(label.tolist()))


def test_near_copies_of_the_corpus(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    want = plain_kept(sorted(texts_of(docs)))
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").select("doc_id").collect()) == want


@pytest.mark.parametrize("flush, part_bytes, common, task_bytes", [(1 << 20, 1 << 24, 255, 1 << 25), (300, 2000, 4, 1 << 25), (300, 2000, 4, 3000), (1 << 20, 1 << 24, 255, 600)])
def test_near_copies_at_the_bound(spark, monkeypatch, flush, part_bytes, common, task_bytes):
    monkeypatch.setattr(near_dedup, "FLUSH", flush)
    monkeypatch.setattr(near_dedup, "PART_BYTES", part_bytes)
    monkeypatch.setattr(near_dedup, "COMMON", common)
    monkeypatch.setattr(near_dedup, "TASK_BYTES", task_bytes)
    rng, texts = random.Random(12), ["", " ", "a", "A ", "a b c d e", "a b c d e f", "License is given to all who keep this line whole " * 3]
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 6)):
            base = [w if rng.random() > 0.03 else f"x{rng.randrange(400)}" for w in base]
            texts.append(" ".join(base + (["license is given to all who keep this line whole"] if rng.random() < 0.5 else [])))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = near_dedup.keep_one(df)
    assert sorted(r.doc_id for r in out.collect()) == plain_kept(docs)


def test_large_components_in_blocks(spark, monkeypatch):
    """Many near copies of a few bases that share a passage, in tasks of a few sets, and a text larger than a task."""
    rng, texts, passage = random.Random(5), [], " ".join(f"p{i}" for i in range(30))
    for b in range(4):
        base = passage.split() + [f"b{b}w{i}" for i in range(10 + 4 * b)]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    long = [f"l{rng.randrange(10**6)}" for _ in range(5000)]
    texts += [" ".join(long), " ".join(long[:4900]), passage, passage + " end"]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain_kept(docs)
    assert sorted(r.doc_id for r in near_dedup.keep_one(df, task_bytes=4000).collect()) == want
    seen, whole = [], near_dedup._linked

    def noted(members, sets, *keys):
        sizes = members.select(*keys, "row").distinct().join(sets.filter("bytes <= 8000").select("row", "bytes"), "row").groupBy(*keys).agg({"bytes": "sum", "row": "count"})
        seen.extend((len(keys), r["sum(bytes)"]) for r in sizes.collect() if r["count(row)"] > 1)
        return whole(members, sets, *keys)

    monkeypatch.setattr(near_dedup, "_linked", noted)
    assert sorted(r.doc_id for r in near_dedup.keep_one(df, task_bytes=8000).collect()) == want
    assert {k for k, _ in seen} >= {3, 4}  # blocks with a head, and what was left outside the largest group
    assert max(n for _, n in seen) <= 4 * 8000


def near_texts(rng, bases, copies):
    out = []
    for b in range(bases):
        base = [f"b{b}w{i}" for i in range(150)]
        out += [" ".join(w if i != at else f"x{rng.randrange(10**6)}" for i, w in enumerate(base)) for at in rng.sample(range(150), copies)]
    return out


def test_trees_group_what_is_similar():
    rng = random.Random(3)
    texts = near_texts(rng, 5, 12) + [f"other {i} text of some words number {i}" for i in range(20)]
    sets = [near_dedup.shingles(t.encode()) for t in texts]
    found, exact = near_dedup.tree_groups(sets), near_dedup.similar_groups(sets)
    assert found.tolist() == exact.tolist() == near_dedup.similar_groups(sets, found).tolist()
    assert len(set(exact.tolist())) == 25


def test_trees_join_only_what_is_similar(monkeypatch):
    """Whatever the radius is, groups are those of the similarity."""
    rng = random.Random(6)
    texts = [t for t in near_texts(rng, 3, 6)] + [" ".join(rng.sample(t.split(), 150)) for t in near_texts(rng, 2, 2)]
    sets = [near_dedup.shingles(t.encode()) for t in texts]
    exact = near_dedup.similar_groups(sets)
    for radius in (0, 3, 64):
        monkeypatch.setattr(near_dedup, "RADIUS", radius)
        found = near_dedup.tree_groups(sets)
        assert all(exact[i] == exact[j] for i in range(len(sets)) for j in range(len(sets)) if found[i] == found[j])
        assert near_dedup.similar_groups(sets, found).tolist() == exact.tolist()


def test_stage_searches_trees(spark, monkeypatch):
    """Components beyond a task go through shards of trees, which settle dense ones before any star is compared."""
    rng = random.Random(9)
    docs = list(enumerate(near_texts(rng, 2, 40)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    searched, rest, links, stars = [], [], near_dedup.simhash.near_links, near_dedup.star_links
    monkeypatch.setattr(near_dedup.simhash, "near_links", lambda fps, n, *a: searched.append(n) or links(fps, n, 64))
    monkeypatch.setattr(near_dedup, "star_links", lambda sets, *a: rest.append(sets.count()) or stars(sets, *a))
    kept = sorted(r.doc_id for r in near_dedup.keep_one(df, task_bytes=20_000).collect())
    assert kept == plain_kept(docs) == [0, 40]
    assert searched and searched[0] > 2 and rest == [0]


def test_trees_search_all_texts(spark, monkeypatch):
    """Texts that no shingle joins to others get a fingerprint and a place in the trees like all others."""
    rng = random.Random(4)
    texts = near_texts(rng, 2, 3) + [" ".join(f"t{i}w{k}" for k in range(40)) for i in range(30)] + ["", "one"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    searched, links = [], near_dedup.simhash.near_links
    monkeypatch.setattr(near_dedup.simhash, "near_links", lambda fps, n, *a: searched.append({r.fp for r in fps.collect()}) or links(fps, n, *a))
    assert sorted(r.doc_id for r in near_dedup.keep_one(df).collect()) == plain_kept(docs)
    want = {near_dedup.simhash.fingerprint(t.encode(), near_dedup.WORDS) for t in texts}
    assert [{fp % 2**64 for fp in s} for s in searched] == [want] and len(want) > 30


def test_groups_of_all_trees_are_checked():
    """What the trees over all texts put together is linked only where the similarity holds."""
    rng = random.Random(2)
    sets = [near_dedup.shingles(t.encode()) for t in near_texts(rng, 3, 5)]
    exact = near_dedup.similar_groups(sets)
    for near in (np.zeros(len(sets), np.int64), np.arange(len(sets)), rng.choices(range(3), k=len(sets))):
        assert near_dedup.tree_groups(sets, np.array(near)).tolist() == exact.tolist()
