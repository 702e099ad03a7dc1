"""The corpus operators against SQL twins, brute force, exact round trips and held-out labels."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from peakloom.llm import bpe, decontamination, exact_dedup, line_dedup, pii, quality, queries, sharding, simhash, suffix_dedup, url_filter
from peakloom.llm.common import table

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, con, name):
    got = queries.QUERIES[name](spark, SMALL).toArrow()
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.schema.names)
    assert sorted(zip(*(got.column(c).to_pylist() for c in names)), key=key) == sorted(want.fetchall(), key=key)


# --- 1: url rules -------------------------------------------------------------------------


def plain_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    best = None
    for verdict, rule in rules:
        h, cut, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(cut + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best[1] if best else None, best[0] if best else "allow"


def test_url_rules_nested_and_over_partitions(spark):
    rng = random.Random(5)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "net", "x.net", "ample.com", "Example.COM", "", "a..b", "com.", "localhost"]
    paths = ["", "/", "/en/", "/en/a", "/e", "/es/x", "/en/a/b"]
    urls = [None, "", "no scheme", "://", "http://com", "x://y://z/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/', '#/en/'])}" for _ in range(400)]
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "www.example.com/en/a"), ("block", "net/es/"), ("block", "b/"), ("allow", "example.com/")]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(4)
    out = url_filter.url_filter(pages, url_filter.rules_table(spark, rules))
    assert rows_of(out, "page_id", "host", "path", "rule", "verdict") == sorted(((i, *plain_verdict(u, rules)) for i, u in enumerate(urls)), key=key)


def test_url_rules_empty(spark):
    pages = spark.createDataFrame([(None, "http://a/b"), (1, None)], "page_id long, url string")
    none = url_filter.rules_table(spark, [("allow", "com/")]).limit(0)
    assert rows_of(url_filter.url_filter(pages, none), "page_id", "verdict") == sorted([(None, "allow"), (1, "allow")], key=key)
    assert url_filter.url_filter(pages.limit(0), none).count() == 0


# --- 2: exact copies ----------------------------------------------------------------------


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("options", [{}, {"table_bytes": 200, "max_ids": 3}])
def test_exact_dedup(spark, awkward, options):
    docs = texts_of(awkward)
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[normal(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, keep[normal(t)], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in docs]
    out = exact_dedup.exact_dedup(awkward, **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=key) == sorted(want, key=key)
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_dedup(awkward.limit(0)).count() == 0


def test_spill_settles_every_level():
    # hashes that agree in all bits but the highest force every level of spill files
    rows = [(k, h, c, (False, k, k), 1) for k, (h, c) in enumerate([(5, b"a" * 50), (5 | 1 << 62, b"b" * 50), (5, b"c" * 50), (5, b"a" * 50), (9, b"d" * 50)])]
    out = {cls: (keep, n) for cls, keep, _, n, _ in exact_dedup.settle(rows, 60, None)}
    assert out == {0: (0, 2), 1: (1, 1), 2: (2, 1), 3: (0, 2), 4: (4, 1)}


def test_keep_first_columns(awkward):
    out = exact_dedup.keep_first(awkward)
    assert out.columns == awkward.columns and out.count() == len({normal(t) for _, t in texts_of(awkward)})


# --- 3: repeated strings ------------------------------------------------------------------


def repeated(texts, length=200):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(x for x, y in zip(t, gone) if not y)))
    return out


@pytest.fixture(scope="module")
def patchwork(spark):
    rng = random.Random(3)
    parts = [bytes(rng.choices(b"abcdefgh ", k=rng.randint(20, 300))) for _ in range(30)]
    texts = [b"".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(40)] + [b"ab" * 300, b"a" * 500, b"", b"x"]
    texts += [bytes(rng.choices(b"xyz", k=150)) + parts[0] + parts[1] + bytes(rng.choices(b"xyz", k=150)) for _ in range(30)]
    df = spark.createDataFrame([(i, t.decode(), "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, h string, row int").repartition(5)
    return df, sorted((i, *r) for i, r in enumerate(repeated(texts)))


@pytest.mark.parametrize("options", [{}, {"filter_max": 0}, {"hot_spots": 3}, {"large": 2}, {"large": 2, "most_bytes": 600}])
def test_suffix_dedup(patchwork, options):
    df, want = patchwork
    out = suffix_dedup.suffix_dedup(df, **options).collect()
    assert sorted((r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r["first"], r["last"])), len(r["first"]), bytes(r.kept)) for r in out) == want


def test_suffix_dedup_awkward(awkward, nothing):
    docs = texts_of(awkward.filter("doc_id is null or doc_id not in (7, 8)"))
    want = sorted(((i, *r) for (i, _), r in zip(docs, repeated([t.encode() for _, t in docs]))), key=key)
    out = suffix_dedup.suffix_dedup(awkward.filter("doc_id is null or doc_id not in (7, 8)")).collect()
    got = [(r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r["first"], r["last"])), len(r["first"]), bytes(r.kept)) for r in out]
    assert sorted(got, key=key) == want
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_merged_transforms_and_very_long_text():
    rng = random.Random(4)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 90))) for _ in range(20)]
    want = collections.Counter(s[i : i + 12] for s in strings for i in range(len(s) - 11))
    shards = [np.frombuffer(b"".join(s + b"\xff" for s in part), np.uint8) + np.uint8(1) for part in (strings[:7], strings[7:])]
    for shard, places in zip(shards, suffix_dedup.merged_intervals(shards, 12)):
        data = (shard - np.uint8(1)).tobytes()
        assert places.tolist() == [i for i in range(len(data) - 11) if b"\xff" not in data[i : i + 12] and want[data[i : i + 12]] > 1]
    # a text longer than a chunk comes in pieces that hold each window once
    text = bytes(rng.choices(b"abcdefghij", k=3 * suffix_dedup.CHUNK // 2))
    starts = []
    for data, index, begin, size, offset in suffix_dedup.chunks([b"short", text]):
        doc, first, last, _, _ = suffix_dedup.contexts(data, begin, size)
        for d, a, b in zip(doc, first, last):
            assert index[d] == 1
            starts += range(a - begin[d] + offset[d], b - begin[d] + offset[d] + 1)
    assert sorted(starts) == list(range(len(text) - 199))


# --- 4: SimHash ---------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    p = np.array(prints, np.uint64)
    label = np.arange(len(p))
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= radius
    while True:
        low = np.where(near, label[None, :], len(p)).min(axis=1)
        if (low == label).all():
            return label
        label = low


def test_simhash_tables(spark):
    docs = sorted(texts_of(table(spark, SMALL, "documents")))
    prints = [plain_fingerprint(t.encode()) for _, t in docs]
    label = plain_components(prints)
    want = sorted(((i, f"{p:016x}", docs[c][0]) for (i, _), p, c in zip(docs, prints, label)), key=key)
    assert rows_of(queries.op4_simhash(spark, SMALL), "doc_id", "fingerprint", "component_id") == want
    # many small shards give the same components
    parts = simhash.simhash_groups(table(spark, SMALL, "documents"), shard_points=8)
    assert rows_of(parts, "doc_id", "fingerprint", "component_id") == want


def test_simhash_awkward(awkward, nothing):
    out = simhash.simhash_groups(awkward).collect()
    assert len(out) == awkward.count() and len({r.row for r in out}) == len(out)
    zero = {r.component_id for r in out if r.fingerprint == "0" * 16}
    assert zero == {3}
    assert simhash.simhash_groups(nothing).count() == 0
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({r.component_id for r in out})


def test_trees_lose_no_link():
    rng = random.Random(8)
    points = {rng.getrandbits(64) for _ in range(300)}
    for base in [*points][:150]:
        for _ in range(4):
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
            points.add(base)
    p = np.array(sorted(points), np.uint64)
    want = plain_components(p)
    for limit in (1 << 20, 2000, 100):
        assert (simhash.shard_groups(p, np.ones(len(p), bool), 3, limit) == want).all()


# --- 5: shards ----------------------------------------------------------------------------


def test_shards(spark, awkward, nothing):
    out = sharding.shard_rows(awkward).collect()
    sizes = collections.Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes[k] for k in range(8)) <= 1
    for k in sizes:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sizes[k]))
    for r in out:
        assert (r.shard, r.slot) == sharding.locate(r.number, len(out)) and sharding.row_at(r.shard, r.slot, len(out)) == r.number
    want = [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts_of(awkward)]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=key) == sorted(want, key=key)
    assert sharding.shard_rows(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 50, 1001])
def test_permutation(n):
    assert sorted(sharding.locate(i, n, 1)[1] for i in range(n)) == list(range(n))


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [25] * 4


# --- 6: quality ---------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op6_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    held = [(out[i].score, q) for i, q in labels.items() if i in out and out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and out[i].predicted == int(out[i].score >= 0.5) for i in out)
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95
    assert np.mean([s >= 0.5 for s in good]) > 0.97


def test_quality_scores_do_not_depend_on_neighbours(spark, awkward, nothing):
    texts = [t.encode() for _, t in texts_of(awkward)]
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.25)
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts], atol=1e-6) and ((0 <= together) & (together <= 1)).all()
    assert model.scores([b""])[0] == pytest.approx(1 / (1 + np.exp(-0.25)))
    out = quality.score_documents(awkward, model).collect()
    assert len(out) == len(texts) and sorted(r.score for r in out) == pytest.approx(sorted(together), abs=1e-6)
    assert quality.score_documents(nothing, model).count() == 0
    kept = quality.keep_good(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == int((together >= 0.5).sum())


def test_quality_sample_of_repeated_ids(spark, monkeypatch):
    """An id with several texts is learned from one of them, the same however rows are dealt; the sample keeps its bounds."""
    rows = [(i, f"{w} text {i} " * 3) for i in range(60) for w in ("good", "other", "third")] + [(5, None), (6, "z" * 9000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, ys: seen.append((texts, ys)))
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        quality.fit(docs, labels)
        quality.fit(docs, labels, most_bytes=1000)
    assert seen[0] == seen[2] and seen[1] == seen[3]
    texts, ys = seen[0]
    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    assert {t.decode() for t in texts} <= {t or "" for _, t in rows}
    small = seen[1][0]
    assert 0 < sum(map(len, small)) <= 1000 and small == [t for t in texts if len(t) <= 62][: len(small)]


def test_quality_without_labels(spark, nothing):
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    assert quality.fit(nothing, labels).scores([b"a b c"]).tolist() == [pytest.approx(0.5, abs=0.2)]


# --- 7: BPE -------------------------------------------------------------------------------


def test_bpe_equals_library(spark, awkward):
    lib, own = Tokenizer.from_file(VOCABULARY), bpe.Codec(VOCABULARY, cache_bytes=20_000)
    edge = ["", "  ", "a  b", " \n\n x", "x\u00a0\u00a0 y", "x\u3000\u3000y  \u00a0 z ", "it's 'tis !'s x!'s  \t\n b", "<|endoftext|> hi <|endoftext|>", "\u65e5\u672c\u8a9e \ud55c\uad6d", "\U0001f600\U0001f600 "]
    edge += ["a\x1c b\x1f\x1fc", "\x85\x85 x", "a" * 3000, "\u0967\u0968 \u0663 x\u00b2", "\u00e9 \u200b\u200b x\ufeff", "don't you'll I'd we've ", "\r\n\r\nfoo\r\n"]
    for text in edge + [t for _, t in texts_of(awkward)] + [t for _, t in texts_of(table(spark, SMALL, "documents"))]:
        want = lib.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False) == text


def test_bpe_pieces_follow_the_merges():
    own, rng = bpe.Codec(VOCABULARY), random.Random(2)
    for _ in range(2000):
        piece = bytes(rng.choices(b"aehinorst'A\xc3\xa9 ", k=rng.randint(1, 14)))
        parts = own.forced_pieces(piece)
        assert b"".join(parts) == piece and [i for p in parts for i in own._piece(p)] == own.merged(piece)


def test_bpe_columns(spark, awkward, nothing):
    out = bpe.encode_documents(awkward, VOCABULARY, ["n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]).collect()
    assert sorted(((r.doc_id, r.decoded) for r in out), key=key) == sorted(texts_of(awkward), key=key)
    for r in out:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_documents(nothing, VOCABULARY, ["n_tokens"]).count() == 0


# --- 8: lines -----------------------------------------------------------------------------


def plain_lines(docs):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = {}
    order = lambda n: (docs[n][0] is None, docs[n][0] if docs[n][0] is not None else n)
    for n, (_, t) in enumerate(docs):
        for line in t.split("\n"):
            k = line.strip(strip).translate(low)
            first[k] = min(first.get(k, order(n)), order(n))
    out = []
    for n, (i, t) in enumerate(docs):
        lines = t.split("\n")
        kept = [x for x in lines if len(k := x.strip(strip).translate(low)) < 10 or first[k] == order(n)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=key)


def test_line_dedup_awkward(awkward, nothing):
    assert rows_of(line_dedup.line_dedup(awkward), "doc_id", "n_lines", "n_dropped", "kept_text") == plain_lines(texts_of(awkward))
    assert line_dedup.line_dedup(nothing).count() == 0


def test_line_dedup_frequent_and_many_lines(spark, monkeypatch):
    rng = random.Random(6)
    lines = [f"a line that is repeated {k}" for k in range(20)] + ["short", "", "  A Line that is repeated 3\t"]
    docs = [(i, "\n".join([rng.choice(lines) if rng.random() < 0.7 else f"only here {i} {k}" for k in range(rng.randint(0, 200))])) for i in range(120)]
    monkeypatch.setattr(line_dedup, "HEAVY_SHARE", 0.00001)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows_of(line_dedup.line_dedup(df), "doc_id", "n_lines", "n_dropped", "kept_text") == plain_lines(docs)


# --- 9: benchmark passages ----------------------------------------------------------------


def plain_hits(docs, items, size=10):
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    windows = collections.defaultdict(set)
    for item, t in items:
        w = split(t or "")
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[a : a + size])].add(str(item))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[k]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=key)


@pytest.mark.parametrize("part_words", [2_000_000, 60])
def test_contamination(spark, awkward, monkeypatch, part_words):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 500)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)] + ["The", "the", "É1"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 10, 11, 25])))) for k in range(20)] + [(99, None), (98, "... --")]
    docs = [(k, " ".join(rng.choices(words, k=30) + (items[rng.randrange(20)][1].split() if rng.random() < 0.5 else []) + rng.choices(words, k=20))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(awkward.select("doc_id", "text")).repartition(3)
    out = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"), part_words=part_words)
    assert rows_of(out, "doc_id", "n_words", "n_hit", "items") == plain_hits(texts_of(df), items)


def test_proximity(spark):
    item = [(5, "one two three four")]
    docs = [(1, "four x three two y one"), (2, "one two x x x x three four"), (3, "one two three"), (4, "one two three four")]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")
    near = {r.doc_id: r.n_hit for r in decontamination.contamination(df, items, slop=2).collect()}
    assert near[1] == 6 and near[2] == 0 and near[3] == 0 and near[4] == 4
    assert [r.doc_id for r in decontamination.contamination(df, items).filter("n_hit > 0").collect()] == [4]


def test_contamination_empty(spark, awkward, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(awkward, items).filter("n_hit > 0").count() == 0
    assert decontamination.contamination(nothing, items).count() == 0
    kept = decontamination.keep_clean(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


# --- 10: personal data --------------------------------------------------------------------


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    cards = ["4539148803436467", "4539 1488 0343 6467", "4337166598464399", "378282246310005", "6011-1111-1111-1117"]
    texts = [f"pay {c}." for c in cards] + ["bad 4539148803436468", "+1 (456) 555-2186 and 456-555-2186", "+1 (056) 555-2186", "10.0.0.255.", "1.2.3.999", "2020-02-29", "1999-02-30", "29/02/2020", "123-45-6789", "000-11-2222", "A.b@x.example.com", "a.B@x.example.com", "12 4539148803436467"]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    shape = lambda t: re.sub(r"\d", "9", t)
    for text, new in zip(texts[:5], out):
        d = re.sub(r"\D", "", new)
        assert shape(text) == shape(new) and text != new and luhn(d) and d[0] == re.sub(r"\D", "", text)[0]
    assert re.sub(r"\D", "", out[0]) == re.sub(r"\D", "", out[1]) == re.sub(r"\D", "", out[17])[2:]
    for unchanged in (5, 9, 11, 14):
        assert out[unchanged] == texts[unchanged]
    assert shape(out[7]) == shape(texts[7]) and out[7] != texts[7]  # an area beginning with 0 is replaced, too
    assert shape(out[6]) == shape(texts[6]) and out[6].split(" and ")[0][3:].replace("(", "").replace(") ", "-") == out[6][-12:] != texts[6][-12:]
    assert all(int(p) < 256 for p in out[8].strip(".").split(".")) and out[8] != texts[8]
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", out[10]) and "/".join(out[10].split("-")[::-1]) == out[12]
    assert out[15] == out[16] and out[15].endswith("@x.example.com") and "b@" not in out[15].lower()[:4]


def test_pseudonyms_are_permutations(spark):
    n = 271 * 270
    x = spark.range(n)
    step = lambda v: pii.feistel(v, 271, 270, "k", "t")
    out = x.select(step(F.col("id")).alias("y")).agg(F.count_distinct("y"), F.min("y"), F.max("y")).first()
    assert tuple(out) == (n, 0, n - 1)
    inside = lambda v: v < 73_049
    out = x.filter("id < 73049").select(pii.walked(F.col("id"), step, inside).alias("y")).agg(F.count_distinct("y"), F.max("y")).first()
    assert tuple(out) == (73_049, 73_048)


def test_pseudonyms_awkward(awkward, nothing):
    out = pii.pseudonymise(awkward).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=key) == sorted(((r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()), key=key)
    assert all(r.n_replaced == 0 and r.kinds == "" for r in out)
    assert pii.pseudonymise(nothing).count() == 0


def test_no_planted_value_is_left(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = {r.doc_id: r for r in pii.pseudonymise(docs).collect()}
    for i, text in texts_of(docs):
        private = re.findall(r"[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{16}\b", text)
        assert not any(p in out[i].text for p in private if not p.isdigit() or luhn(p))
        assert out[i].n_replaced or out[i].text == text
