"""SimHash near-duplicates with vantage-point trees over Hamming distance.

Fingerprints are grouped first, so copies cost one point. A vantage-point tree over a bounded
sample cuts the space into shards: at each node the points within the median distance of the
vantage point go left, the others right. A pair within ``radius`` can only be parted at a node if its
left point is within ``radius`` of the boundary (triangle bound), so just those left points also
visit the right side; every pair meets in the home shard of one of its two. Inside a shard the same
tree is grown on until leaves are small, where all distances are counted exactly. A shard returns a
spanning star per group it finds, never all pairs, and the groups are joined by components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from peakloom.llm.common import fresh, settled, stored, text_bytes
from peakloom.operators.components import connected_components

SEED, WORDS, RADIUS = 42, 3, 3
SHARD_POINTS = 20_000
SAMPLE_PER_SHARD = 48
LEAF_PAIRS = 1 << 20


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles; a bit is 1 if more than half of the hashes have it."""
    w = text.lower().split()  # on bytes both treat ASCII only
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(w) - words + 1].tolist()
    return majority(np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[a : a + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "row", "fp"])

    return run


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


class Tree:
    """A vantage-point tree of fixed depth; node k has the children 2k+1 and 2k+2."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.vantage = np.zeros(2**depth - 1, np.uint64)
        self.median = np.zeros(2**depth - 1, np.int16)
        parts = {0: sample}
        for k in range(2**depth - 1):
            own = parts.pop(k)
            if len(own):
                self.vantage[k] = own[0]
                d = np.bitwise_count(own ^ own[0]).astype(np.int16)
                self.median[k] = np.median(d)
            else:
                d = np.zeros(0, np.int16)
            parts[2 * k + 1], parts[2 * k + 2] = own[d <= self.median[k]], own[d > self.median[k]]

    def route(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, shard, is it the home shard) for all shards a point has to be in."""
        node, which, home = np.zeros(len(points), np.int64), np.arange(len(points)), np.ones(len(points), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(points[which] ^ self.vantage[node]).astype(np.int16)
            m = self.median[node]
            left = np.where(home, d <= m, d - radius <= m)
            right = np.where(home, d > m, d + radius > m)
            over = home & left & (d + radius > m)
            node, which, home = (
                np.concatenate([2 * node[left] + 1, 2 * node[right] + 2, 2 * node[over] + 2]),
                np.concatenate([which[left], which[right], which[over]]),
                np.concatenate([home[left], home[right], np.zeros(int(over.sum()), bool)]),
            )
        return which, node - (2**self.depth - 1), home


def _routed(tree: Tree, radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            which, shard, home = tree.route(points, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(points[which].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    return run


class Groups:
    """Labels of points, lowered to the smallest label of whatever is linked to them."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = self.roots(a), self.roots(b)
            differ = x != y
            if not differ.any():
                return
            x, y = x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))

    def roots(self, a: np.ndarray) -> np.ndarray:
        x = self.label[a]
        while not np.array_equal(y := self.label[x], x):
            x = y
        self.label[a] = x
        return x


def shard_groups(points: np.ndarray, home: np.ndarray, radius: int = RADIUS, leaf_pairs: int = LEAF_PAIRS) -> np.ndarray:
    """Labels: points linked, directly or by others, through pairs with at least one home point.

    Pairs are found exactly; memory is bounded by ``leaf_pairs`` distances at a time.
    """
    groups = Groups(len(points))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, guests = todo.pop()
        if not len(own):
            continue
        everyone = np.concatenate([own, guests])
        if len(own) * len(everyone) > leaf_pairs:
            vantage = points[own[0]]
            d, g = np.bitwise_count(points[own] ^ vantage).astype(np.int16), np.bitwise_count(points[guests] ^ vantage).astype(np.int16)
            m = np.median(d)
            over = (d <= m) & (d + radius > m)
            near = own[d <= m], guests[g - radius <= m]
            far = own[d > m], np.concatenate([guests[g + radius > m], own[over]])
            work = [len(a) * (len(a) + len(b)) for a, b in (near, far)]
            if sum(work) < 0.9 * len(own) * len(everyone):
                todo += [near, far]
                continue
        step = max(1, leaf_pairs // len(everyone))
        for a in range(0, len(own), step):
            i, j = np.nonzero(distances(points[own[a : a + step]], points[everyone]) <= radius)
            groups.link(own[a + i], everyone[j])
    return groups.roots(np.arange(len(points)))


def _stars(radius: int):
    def run(t: pa.Table) -> pa.Table:
        points, home = t.column("fp").to_numpy().view(np.uint64), np.array(t.column("home").to_pylist(), bool)
        label = shard_groups(points, home, radius)
        linked = label != np.arange(len(label))
        return pa.table({"a": pa.array(points[linked].view(np.int64)), "b": pa.array(points[label[linked]].view(np.int64))})

    return run


def near_links(fps: DataFrame, n: int, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links (a, b) that connect all of the ``n`` distinct values ``fp`` within ``radius`` of each other."""
    depth = max(0, math.ceil(math.log2(max(1, n / shard_points))))
    # The sample only decides where the shards lie: SAMPLE_PER_SHARD points for each.
    sample = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_PER_SHARD * 2**depth).toArrow()
    tree = Tree(sample.column("fp").to_numpy().view(np.uint64), depth)
    routed = fps.select("fp").mapInArrow(_routed(tree, radius), "shard bigint, fp bigint, home boolean")
    return routed.groupBy("shard").applyInArrow(_stars(radius), "a bigint, b bigint")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None, words: int = WORDS) -> DataFrame:
    """(doc_id, row, fp) of every row, stored; a null text has no words."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), number.alias("row"), text_bytes(text_col).alias("t"))
    return stored(base.mapInArrow(_fingerprints(words), "doc_id bigint, row bigint, fp bigint"), "fingerprints")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None, radius: int = RADIUS, shard_points: int = SHARD_POINTS
) -> DataFrame:
    """(doc_id, row, fingerprint, component_id, keep_row) of every row.

    Rows link at ``radius`` or fewer differing bits; ``component_id`` is the smallest id reachable (null
    only where all ids of the component are null) and ``keep_row`` the row that has it, null ids last,
    ties by ``row``. Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows link. An empty table gives no rows; other columns are not read.
    """
    fps = document_fingerprints(docs, id_col, text_col, row)
    first = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")
    points = stored(fps.groupBy("fp").agg(F.min(first).alias("first")), "points")
    links = stored(near_links(points.select("fp"), points.count(), radius, shard_points), "links")
    parts = connected_components(links, "a", "b")
    home = points.join(parts, points["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = home.groupBy("component").agg(F.min("first").alias("low"))
    labels = home.select("fp", "component").join(lowest, "component").select("fp", "low")
    return fps.join(labels, "fp").select(
        "doc_id", "row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(~F.col("low.missing"), F.col("low.id")).alias("component_id"), F.col("low.row").alias("keep_row")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each near-duplicate component, with all columns."""
    row = fresh(docs, "_row")
    numbered = settled(docs).withColumn(row, F.monotonically_increasing_id())
    kept = simhash_groups(numbered, row=row).filter("row = keep_row").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
