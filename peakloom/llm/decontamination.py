"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in blocks of about ``BLOCK_WORDS`` words: for every benchmark term that occurs
in a block, the ascending list of its positions, with a gap between documents so that no phrase can
cross. Blocks are rows of a stored table, so a lost executor costs some blocks only. A window of a benchmark
item is searched in a block from its rarest term there: its positions minus the offset of the term are
candidate starts, which are intersected with the offset-adjusted lists of the other terms in order of
rarity. All windows of a block are intersected at once, a bounded number of candidates at a time.
With ``slop`` the terms may stand anywhere within the window's length plus ``slop`` words (proximity).

The benchmark is the stated query set; it is searched in parts of at most ``PART_WORDS`` words, so what
the tasks receive is bounded whatever its size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from peakloom.llm.common import fresh, settled, stored, text_bytes

WINDOW = 10
BLOCK_WORDS = 1 << 20
PART_WORDS = 2_000_000
CANDIDATES = 1 << 20

#: Runs of ASCII digits, letters (after lower-casing) and all bytes beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Phrases:
    """Distinct windows of a part of the benchmark: term numbers (-1 beyond the length) and their items."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    lengths: np.ndarray
    of_window: np.ndarray
    of_item: np.ndarray
    items: list[str]

    @staticmethod
    def of(rows: list[tuple[str, bytes]], window: int) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        items = sorted({i for i, _ in rows})
        number = {item: k for k, item in enumerate(items)}
        for item, text in rows:
            t = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            for a in range(max(1, len(t) - window + 1) if t else 0):
                found.setdefault(tuple(t[a : a + window]), set()).add(number[item])
        terms = np.full((len(found), window), -1, np.int64)
        for k, t in enumerate(found):
            terms[k, : len(t)] = t
        links = [(k, i) for k, own in enumerate(found.values()) for i in own]
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return Phrases(vocabulary, terms, (terms >= 0).sum(axis=1), pairs[:, 0], pairs[:, 1], items)


class Block:
    """Positions of every term in a run of documents."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, n_terms: int) -> None:
        self.count, self.begin, self.places = np.zeros(n_terms + 1, np.int64), np.zeros(n_terms + 1, np.int64), places
        self.count[terms] = counts
        self.begin[terms] = np.cumsum(counts) - counts
        self.keys = np.repeat(terms, counts) << 40 | places

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        keys = terms << 40 | places
        at = np.searchsorted(self.keys, keys)
        return (places >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def number_within(self, terms: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, terms << 40 | np.maximum(last, 0)) - np.searchsorted(self.keys, terms << 40 | np.maximum(first, 0))

    def search(self, phrases: Phrases, slop: int, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of all matches; ``begin`` has the first place of every document."""
        big = np.iinfo(np.int64).max
        counts = np.where(phrases.terms >= 0, self.count[phrases.terms], big)
        possible = np.flatnonzero(counts.min(axis=1, initial=big) > 0) if len(counts) else np.zeros(0, np.int64)
        if not len(possible):
            return
        order = np.argsort(counts[possible], axis=1, kind="stable")
        rarest = phrases.terms[possible, order[:, 0]]
        cost = np.cumsum(self.count[rarest] * (1 if not slop else phrases.terms.shape[1] + slop))
        for group in np.split(np.arange(len(possible)), np.flatnonzero(np.diff(cost // CANDIDATES)) + 1):
            # one window may have more candidates than fit; its list is cut into pieces
            size = self.count[rarest[group]]
            for skip in range(0, int(size.max()), CANDIDATES):
                take = np.clip(size - skip, 0, CANDIDATES)
                which = np.repeat(group, take)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(take) - take, take) + skip
                place = self.places[self.begin[rarest[which]] + nth]
                yield from self._near(phrases, possible, order, which, place, slop, begin) if slop else self._exact(phrases, possible, order, which, place)

    def _exact(self, phrases, possible, order, which, place):
        start = place - order[which, 0]
        for k in range(1, phrases.terms.shape[1]):
            offset = order[which, k]
            term = phrases.terms[possible[which], offset]
            ok = (term < 0) | self.has(np.maximum(term, 0), start + offset)
            which, start = which[ok], start[ok]
        ok = start >= 0
        yield possible[which[ok]], start[ok]

    def _near(self, phrases, possible, order, which, place, slop, begin):
        """Starts of spans of length plus slop words that hold all terms, each as often as the window has it.

        A span begins in its document: one from the gap before it holds no more than the one from its first word.
        """
        least = begin[np.searchsorted(begin, place, "right") - 1]
        for back in range(phrases.terms.shape[1] + slop):
            span = phrases.lengths[possible[which]] + slop
            ok = (back < span) & (place - back >= least)
            w, start = which[ok], place[ok] - back
            for k in range(phrases.terms.shape[1]):
                row = phrases.terms[possible[w]]
                term = row[np.arange(len(w)), order[w, k]]
                need = (row == term[:, None]).sum(axis=1)
                end = start + phrases.lengths[possible[w]] + slop
                good = (term < 0) | (self.number_within(np.maximum(term, 0), start, end) >= need)
                w, start = w[good], start[good]
            yield possible[w], start


_INDEX = pa.schema(
    [("docs", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("steps", pa.binary())]
)
_INDEX_SQL = "docs array<bigint>, rows array<bigint>, sizes array<bigint>, terms binary, counts binary, steps binary"


def _index(shared, gap: int):
    def block(docs, rows, sizes, parts) -> pa.RecordBatch:
        begin = np.cumsum([0, *(n + gap for n in sizes)])[:-1]
        terms = np.concatenate(parts)
        place = np.concatenate([np.arange(n) + b for n, b in zip(sizes, begin)])
        known = terms >= 0
        terms, place = terms[known], place[known]
        order = np.argsort(terms, kind="stable")
        terms, place = terms[order], place[order]
        names, counts = np.unique(terms, return_counts=True)
        steps = np.diff(place, prepend=0)
        pack = lambda a: zlib.compress(a.astype("<i4").tobytes(), 1)
        cols = [[docs], [rows], [sizes], [pack(names)], [pack(counts)], [pack(steps)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _INDEX)], schema=_INDEX)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.vocabulary.get
        docs, rows, sizes, parts, n = [], [], [], [], 0
        for batch in batches:
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = words(text)
                docs.append(doc)
                rows.append(row)
                sizes.append(len(found))
                parts.append(np.array([number(w, -1) for w in found], np.int64))
                n += len(found) + gap
                if n >= BLOCK_WORDS:
                    yield block(docs, rows, sizes, parts)
                    docs, rows, sizes, parts, n = [], [], [], [], 0
        if docs:
            yield block(docs, rows, sizes, parts)

    return run


_HITS = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)
_HITS_SQL = "doc_id bigint, row bigint, n_words bigint, first array<bigint>, last array<bigint>, items array<string>"


def _search(shared, gap: int, slop: int):
    unpack = lambda b: np.frombuffer(zlib.decompress(b), "<i4").astype(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                docs, rows, sizes, terms, counts, steps = (c[i].as_py() for c in batch.columns)
                block = Block(unpack(terms), unpack(counts), np.cumsum(unpack(steps)), len(phrases.vocabulary))
                begin = np.cumsum([0, *(n + gap for n in sizes)])
                depth = np.zeros(begin[-1] + 1, np.int64)
                pairs = [np.zeros((0, 2), np.int64)]
                for window, start in block.search(phrases, slop, begin):
                    end = start + phrases.lengths[window] + slop
                    np.add.at(depth, start, 1)
                    np.add.at(depth, np.minimum(end, begin[-1]), -1)
                    a = np.searchsorted(phrases.of_window, window, "left")
                    size = np.searchsorted(phrases.of_window, window, "right") - a
                    doc = np.repeat(np.searchsorted(begin, start, "right") - 1, size)
                    item = phrases.of_item[np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                    pairs.append(np.unique(np.stack([doc, item], axis=1), axis=0))
                # runs of hit words; those that go on through the gap of a document end with it
                edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(depth) > 0).astype(np.int8), [0]])))
                first, last = edges[::2], edges[1::2]
                owner = np.searchsorted(begin, first, "right") - 1
                last = np.minimum(last, begin[owner] + np.array(sizes, np.int64)[owner]) if len(first) else last
                first, last = first - begin[owner], last - begin[owner]
                lo, hi = np.searchsorted(owner, np.arange(len(docs))), np.searchsorted(owner, np.arange(len(docs)), "right")
                found = np.unique(np.concatenate(pairs), axis=0)
                p, q = np.searchsorted(found[:, 0], np.arange(len(docs))), np.searchsorted(found[:, 0], np.arange(len(docs)), "right")
                cols = [
                    docs, rows, sizes, [first[a:b] for a, b in zip(lo, hi)], [last[a:b] for a, b in zip(lo, hi)],
                    [sorted(phrases.items[k] for k in found[a:b, 1]) for a, b in zip(p, q)],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _HITS)], schema=_HITS)

    return run


def _parts(benchmark: DataFrame, id_col: str, text_col: str, window: int, part_words: int) -> Iterator[Phrases]:
    """The benchmark in parts of bounded size, by a running sum of text lengths (two bytes a word at least)."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_bytes(text_col).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // (2 * part_words)))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    for p in range(parts):
        t = dealt.filter(F.col("part") == p).select("item", "t").toArrow()
        yield Phrases.of(list(zip(t.column("item").to_pylist(), t.column("t").to_pylist())), window)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    row: str | None = None, window: int = WINDOW, slop: int = 0, part_words: int = PART_WORDS,
) -> DataFrame:
    """(doc_id, row, n_words, n_hit, first, last, items) of every row of ``docs``.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one
    window. ``first`` and ``last`` bound the runs of hit words (end exclusive), ``items`` are the ids, as
    sorted strings, of the items with a window in the document. Null texts have no words; a null item
    id counts as an empty string, equal ids as one item. Null and repeated document ids pass through,
    empty tables give no rows or no hits, other columns are not read. With ``slop`` the matches are
    proximity matches and a hit covers the whole span.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    docs = settled(docs) if row is None else docs
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), number.alias("row"), text_bytes(text_col).alias("t"))
    gap = window + slop
    found = None
    for phrases in _parts(benchmark, item_col, item_text, window, part_words):
        shared = docs.sparkSession.sparkContext.broadcast(phrases)  # bounded by part_words
        index = stored(base.mapInArrow(_index(shared, gap), _INDEX_SQL), "positions")
        hits = index.mapInArrow(_search(shared, gap, slop), _HITS_SQL)
        found = hits if found is None else found.unionByName(hits)
        several = found is not hits
    if several:
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("first", "last"))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        # one run list per part of the benchmark: merge those that overlap or touch
        merged = F.aggregate(
            F.array_sort("runs"),
            F.array().cast("array<struct<first:bigint,last:bigint>>"),
            lambda acc, r: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= r["first"]),
                F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(acc, F.lit(-1))["last"], r["last"]).alias("last")))),
            ).otherwise(F.concat(acc, F.array(F.struct(r["first"].alias("first"), r["last"].alias("last"))))),
        )
        found = found.withColumn("runs", merged).select("doc_id", "row", "n_words", F.col("runs.first").alias("first"), F.col("runs.last").alias("last"), "items")
    hit = F.aggregate(F.zip_with("first", "last", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda n, x: n + x)
    return found.select("doc_id", "row", "n_words", hit.alias("n_hit"), "first", "last", "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns.

    Null texts and texts without words have no hit and stay; repeated rows and ids are judged one by one; texts of any
    length are searched whole. An empty table gives no rows, an empty benchmark keeps all; other columns pass through
    under any name.
    """
    row = fresh(docs, "_row")
    numbered = settled(docs).withColumn(row, F.monotonically_increasing_id())
    dirty = contamination(numbered, benchmark, row=row, **options).filter("n_hit > 0").select(F.col("row").alias(row))
    return numbered.join(dirty, row, "left_anti").drop(row)
