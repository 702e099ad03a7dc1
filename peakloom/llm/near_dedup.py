"""Near-duplicates by SimHash, vantage-point trees and exact shingle similarity, without a pair list.

Two texts are near-duplicates if their sets of word shingles have a Jaccard similarity of at least
``NEAR``. Every text gets a SimHash fingerprint, and vantage-point trees over the fingerprints of all texts
(``simhash``) put together those within its radius. What they put together is linked where the similarity holds.

No radius is sure to hold all pairs of a similarity (pairs at the bound differ in 2 to 11 bits as measured, at which
trees part little), so texts that trees leave apart also meet by their prefixes. Similar sets share 4/5 of either, so
under any common order of all shingles the first of what they share stands in the first fifth, plus one, of both (prefix
filter). The order is by rarity: a shingle that occurs once cannot be shared. Texts with a common prefix shingle are
joined to candidate components by a star per shingle, so no similar pair is in two of them, and what trees put together is
checked inside them; there equal sets are folded and similarities are counted on the full sets. Components of up to
``WIDE_POINTS`` fingerprints are searched once more by trees of their own at ``RADIUS``. Sets of one group need no more link.

A component of at most ``TASK_BYTES`` of sets is one group of a task. A larger one is taken apart by its
stars, in which all pairs with a common prefix shingle meet, unless trees have settled it; a star beyond that size is parted by size
classes, since similar sets are of similar size, and then into blocks. Each block meets the head of the first
one, which joins most of what belongs together; after that only the sets outside the largest group
found so far have still to meet all blocks (a pair inside that group needs no link any more). Nothing is
dropped: every pair with a common prefix shingle is in a common group of a task or has been joined by others.

Shingles are counted by ``TOKEN_BITS`` bits of their hash. Equal bits of different shingles can only
make more candidates; the similarity itself is counted on all 64 bits. A shingle that is common within
one batch of a task counts as ``COMMON`` and does not travel to the part that counts it, only a mark does.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from peakloom.llm import simhash
from peakloom.llm.common import fresh, settled, stored, text_bytes
from peakloom.operators.components import connected_components

SEED, WORDS = 42, 5
NEAR = 4, 5  # similarity as a fraction
TOKEN_BITS = 40
PART_BYTES = 1 << 24
TASK_BYTES = 1 << 25
FLUSH = 1 << 20
COMMON = 255
RADIUS = 11
WIDE_POINTS = 1 << 12
SIZE_CLASS = 1.26  # a little more than the largest ratio of similar sizes, 5/4


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the word shingles, ascending; a text of fewer words, or none, is one shingle."""
    w = text.lower().split()  # on bytes both treat ASCII only
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(w) - words + 1].tolist()
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64))


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(">u8").ravel().astype(np.uint64)


_TOKENS = "rows binary, sizes binary, counts binary, tokens binary"
_COLUMNS = ("rows", "sizes", "counts", "tokens")
_MARK = -1  # in place of a row: the token is common


def _grouped(key: np.ndarray, row: np.ndarray, size: np.ndarray, text: np.ndarray, tokens: np.ndarray) -> list[tuple]:
    """(key, rows, sizes, counts, tokens) by key: of each text with tokens its row, its number of shingles and how many are here."""
    order = np.argsort(key, kind="stable")
    names, begin = np.unique(key[order], return_index=True)
    text, tokens, out = text[order], tokens[order], []
    for a, b in zip(begin, [*begin[1:], len(order)]):
        own, counts = np.unique(text[a:b], return_counts=True)
        out.append((int(names[len(out)]), row[own].tobytes(), size[own].tobytes(), counts.astype(np.uint32).tobytes(), tokens[a:b].tobytes()))
    return out


def _ranked(times: np.ndarray, token: np.ndarray, common: int) -> np.ndarray:
    return _packed(np.minimum(times, common).astype(np.uint64) << np.uint64(TOKEN_BITS) | token, TOKEN_BITS // 8 + 1)


def _dealt(parts: int, batch: int, common: int):
    """Tokens by part of their hash; those common within a batch go, ranked, to the bucket of their text, and a mark to the part."""

    def flush(rows: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        row = np.array([*rows, _MARK], np.int64)
        size = np.array([*map(len, sets), 0], np.uint32)
        token, text = np.concatenate(sets) >> np.uint64(64 - TOKEN_BITS), np.repeat(np.arange(len(row)), size)
        names, which, times = np.unique(token, return_inverse=True, return_counts=True)
        often = times[which] >= common
        marks = names[times >= common]
        ready = _grouped((row % parts)[text[often]], row, size, text[often], _ranked(times[which[often]], token[often], common))
        token, text = np.concatenate([token[~often], marks]), np.concatenate([text[~often], np.full(len(marks), len(rows))])
        open_ = _grouped((token % np.uint64(parts)).astype(np.int64), row, size, text, _packed(token, TOKEN_BITS // 8))
        key, *columns = zip(*ready, *open_)
        flags = [True] * len(ready) + [False] * len(open_)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(flags), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "ready", *_COLUMNS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sets, n = [], [], 0
        for table in batches:
            for row, text in zip(table.column(0).to_pylist(), table.column(1)):
                rows.append(row)
                sets.append(shingles(text.as_py()))
                n += len(sets[-1])
                if n >= batch:
                    yield flush(rows, sets)
                    rows, sets, n = [], [], 0
        if rows:
            yield flush(rows, sets)

    return run


def _repeated(buckets: int, common: int):
    """Of the tokens of a part those that occur again, each behind its number of occurrences, by bucket of the text."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("ready")[0].as_py():
            return t.select(["part", *_COLUMNS]).rename_columns(["bucket", *_COLUMNS])
        rows, sizes, counts, data = (b"".join(t.column(c).to_pylist()) for c in _COLUMNS)
        row, size, count = np.frombuffer(rows, np.int64), np.frombuffer(sizes, np.uint32), np.frombuffer(counts, np.uint32)
        token, text = _unpacked(data, TOKEN_BITS // 8), np.repeat(np.arange(len(row)), count)
        mark = (row == _MARK)[text]
        _, which = np.unique(token, return_inverse=True)
        times = np.bincount(which, np.where(mark, common, 1))[which]
        again = (times > 1) & ~mark
        text = text[again]
        # numbers of rows follow each other, so their remainders are even
        out = _grouped((row % buckets)[text], row, size, text, _ranked(times[again], token[again], common))
        key, *columns = zip(*out) if out else [()] * 5
        return pa.table([pa.array(key, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", *_COLUMNS])

    return run


def _prefixes(t: pa.Table) -> pa.Table:
    """(token, row): the prefix of each text of a bucket, as far as it holds tokens that occur again."""
    rows, sizes, counts, data = (b"".join(t.column(c).to_pylist()) for c in _COLUMNS)
    count = np.frombuffer(counts, np.uint32)
    row, rank = np.repeat(np.frombuffer(rows, np.int64), count), _unpacked(data, TOKEN_BITS // 8 + 1)
    size = np.repeat(np.frombuffer(sizes, np.uint32).astype(np.int64), count)
    order = np.lexsort((rank, row))
    row, rank, size = row[order], rank[order], size[order]
    _, begin, n = np.unique(row, return_index=True, return_counts=True)
    nth = np.arange(len(row)) - np.repeat(begin, n)
    # prefix of size - ceil(4/5 size) + 1 shingles, less those that occur once and come first
    take = np.repeat(n, n) + 1 - (NEAR[0] * size + NEAR[1] - 1) // NEAR[1]
    own = nth < take
    token = (rank[own] & np.uint64((1 << TOKEN_BITS) - 1)).astype(np.int64)
    return pa.table({"token": token, "row": row[own]})


def prefix_tokens(base: DataFrame) -> DataFrame:
    """(token, row): the prefix of each row of ``base`` (row, t), as far as its shingles occur again; stored."""
    total = base.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    parts = total // PART_BYTES + 1
    dealt = base.select("row", "t").mapInArrow(_dealt(parts, FLUSH, COMMON), "part bigint, ready boolean, " + _TOKENS)
    again = dealt.groupBy("part", "ready").applyInArrow(_repeated(parts, COMMON), "bucket bigint, " + _TOKENS)
    return stored(again.groupBy("bucket").applyInArrow(_prefixes, "token bigint, row bigint").distinct(), "prefixes")


def candidate_stars(prefixes: DataFrame) -> DataFrame:
    """(row, low): each row with the smallest row of each of its prefix tokens, itself excluded."""
    stars = prefixes.groupBy("token").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("token", "low")
    return prefixes.join(stars, "token").filter("row <> low").select("row", "low").distinct()


def similar_groups(sets: list[np.ndarray], group: np.ndarray | None = None) -> np.ndarray:
    """A label per set; sets linked, directly or by others, through similarities of at least ``NEAR`` share it.

    ``group``: a value per set; sets that share it are known to be linked.
    """
    size = np.array([len(s) for s in sets], np.int64)
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(times), np.int64)
    place[np.argsort(times, kind="stable")] = np.arange(len(times))
    own = [np.sort(x) for x in np.split(place[which], np.cumsum(size)[:-1])]
    label, mark, index = np.arange(len(sets)) if group is None else _firsts(group), np.zeros(len(times), bool), defaultdict(list)
    for i in np.argsort(size, kind="stable").tolist():
        prefix = own[i][: size[i] - (NEAR[0] * size[i] + NEAR[1] - 1) // NEAR[1] + 1].tolist()
        near = set()
        for x in prefix:
            near.update(index[x])
            index[x].append(i)
        other = np.fromiter(near, np.int64, len(near))
        other = other[NEAR[1] * size[other] >= NEAR[0] * size[i]]
        mark[own[i]] = True
        while len(other := other[label[other] != label[i]]):
            # one member after the other, until one links and its whole group is settled
            for at, j in enumerate(other.tolist()):
                both = int(np.count_nonzero(mark[own[j]]))
                if NEAR[1] * both >= NEAR[0] * (size[i] + size[j] - both):
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
                    break
            other = other[at + 1 :]
        mark[own[i]] = False
    return label


def _either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A label per place; places with one value of ``a`` or one of ``b`` share it, directly or by others."""
    groups, own = simhash.Groups(len(a)), np.arange(len(a))
    groups.link(own, _firsts(a))
    groups.link(own, _firsts(b))
    return groups.roots(own)


def _firsts(group: np.ndarray) -> np.ndarray:
    """For each value the place at which it comes first."""
    _, first, which = np.unique(group, return_index=True, return_inverse=True)
    return first[which]


def tree_groups(sets: list[np.ndarray], near: np.ndarray | None = None) -> np.ndarray:
    """A label per set: of what vantage-point trees put together, sets linked by their similarity share it.

    ``near``: a value per set, shared by those that trees over all texts put together. A small component is searched at ``RADIUS`` besides.
    """
    points, which = np.unique(np.array([simhash.majority(s) for s in sets], np.uint64), return_inverse=True)
    if near is None or len(points) <= WIDE_POINTS:
        radius = RADIUS if len(points) <= WIDE_POINTS else simhash.RADIUS
        wide = simhash.shard_groups(points, np.ones(len(points), bool), radius)[which]
        near = wide if near is None else _either(wide, near)
    order = np.argsort(near, kind="stable")
    label = np.arange(len(sets))
    for own in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
        if len(own) > 1:
            label[own] = own[similar_groups([sets[i] for i in own])]
    return label


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t).tobytes() for t in batch.column(3).to_pylist()]
        digests = [xxhash.xxh128_digest(s) for s in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["component", "row", "doc_id", "digest", "shingles"])


def _lowest(t: pa.Table) -> pa.Table:
    """The row of the smallest id of each group of similar sets in a candidate component."""
    firsts = [(f["missing"], f["id"], f["row"]) for f in t.column("first").to_pylist()]
    low: dict[int, tuple] = {}
    sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
    for label, first in zip(similar_groups(sets, tree_groups(sets, t.column("near").to_numpy())).tolist(), firsts):
        low[label] = min(low.get(label, first), first)
    return pa.table({"row": pa.array([f[2] for f in low.values()], pa.int64())})


def _links(t: pa.Table) -> pa.Table:
    """(row, low): a star around the lowest row for each group of similar sets among those given; ``group``: as in ``similar_groups``."""
    t = t.sort_by("row")
    row = t.column("row").to_numpy()
    label = similar_groups([np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()], t.column("group").to_numpy())
    linked = label != np.arange(len(label))
    return pa.table({"row": pa.array(row[linked]), "low": pa.array(row[label[linked]])})


def _linked(members: DataFrame, sets: DataFrame, *keys: str) -> DataFrame:
    """Links among the sets of each group of ``members`` (keys, row)."""
    full = members.select(*keys, "row").distinct().join(sets.select("row", "shingles", "group"), "row")
    return full.groupBy(*keys).applyInArrow(_links, "row bigint, low bigint")


def tree_search(docs: DataFrame, id_col: str, text_col: str, row: str) -> DataFrame:
    """(row, near) of every row: ``near`` is shared by those that vantage-point trees over the fingerprints of all texts put together.

    One fingerprint of each text, of shingles of ``WORDS`` words; equal ones are one point of the trees.
    """
    fps = simhash.document_fingerprints(docs, id_col, text_col, row, WORDS)
    points = stored(fps.select("fp").distinct(), "points")
    links = stored(simhash.near_links(points, points.count()), "links")
    parts = connected_components(links, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("near"))
    return fps.join(parts, "fp", "left").select("row", F.coalesce("near", "fp").alias("near"))


def tree_links(sets: DataFrame, task_bytes: int) -> DataFrame:
    """(row, low): links between similar ``sets`` (component, row, shingles, bytes, near) that vantage-point trees put together.

    ``low`` is the lowest row of a group and none of its links; each other row has one link at most. A task holds some
    ``task_bytes`` of sets: what the trees put together is parted into blocks, each with the lowest row of all.
    """
    groups = sets.groupBy("component", "near").agg(F.min("row").alias("low"), F.ceil(2 * F.sum("bytes") / task_bytes).alias("blocks"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.filter("n > 1").select("component", "near", "low", "blocks"), "tree-groups")
    members = sets.select("component", "near", "row").join(groups, ["component", "near"]).select("low", "row", F.pmod(F.xxhash64("row", F.lit(19)), F.col("blocks")).alias("block"))
    guests = groups.select("low", F.col("low").alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return stored(_linked(members.unionByName(guests), sets.withColumn("group", F.col("row")), "low", "block"), "tree-links")


def star_links(sets: DataFrame, stars: DataFrame, task_bytes: int) -> DataFrame:
    """(row, low): links that join all similar ``sets`` (row, shingles, bytes, group) that share a star (row, low).

    A task holds some ``task_bytes`` of sets, and one set at least. ``group``: a row that a set is known to be linked to, or its own.
    """
    own = stars.join(sets.select("row"), "row", "left_semi")
    # equal sets have equal prefixes, so the smallest row of a token is never one that was folded
    members = own.unionByName(own.select(F.col("low").alias("row"), "low").distinct())
    members = stored(members.join(sets.select("row", "bytes", F.floor(F.log("n") / math.log(SIZE_CLASS)).alias("size")), "row"), "stars")
    stars_of = stored(members.groupBy("low").agg(F.sum("bytes").alias("all"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "star-sizes")
    total = stars_of.filter(F.col("all") <= task_bytes).agg(F.coalesce(F.sum("all"), F.lit(0)).alias("n")).first()["n"]
    small = members.join(stars_of.filter(F.col("all") <= task_bytes).select("low"), "low")
    known = sets.filter("row <> group").select("row", F.col("group").alias("low"))
    found = known.unionByName(_linked(small.withColumn("task", F.pmod(F.xxhash64("low"), F.lit(total // task_bytes + 1))), sets, "task"))

    # stars beyond one task: a set meets its own size class and, as a guest, the next
    large = members.join(stars_of.filter(F.col("all") > task_bytes).select("low"), "low")
    units = large.select("low", "row", "bytes", F.explode(F.array("size", F.col("size") + 1)).alias("size"))
    place = F.xxhash64("row", F.lit(17))
    blocks = units.groupBy("low", "size").agg(F.ceil(2 * F.sum("bytes") / task_bytes).alias("blocks"))
    units = stored(units.join(blocks, ["low", "size"]).withColumn("block", F.pmod(place, F.col("blocks"))), "star-blocks")
    if units.isEmpty():
        return found
    head = units.filter("block = 0 and blocks > 1").filter(F.pmod(F.xxhash64("row", F.lit(18)), F.lit(4)) == 0)
    guests = head.withColumn("block", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("blocks") - 1)))
    found = stored(found.unionByName(_linked(units.unionByName(guests), sets, "low", "size", "block")), "star-links")

    groups = connected_components(found, "row", "low")
    labelled = stored(units.join(groups, units["row"] == groups["node"], "left").select(*units.columns, F.coalesce("component", "row").alias("group")), "star-groups")
    sizes = labelled.groupBy("low", "size", "group").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("low", "size").agg(F.max(F.struct("n", "group"))["group"].alias("most"))
    rest = labelled.join(most, ["low", "size"]).filter("group <> most and blocks > 1")
    shares = rest.groupBy("low", "size").agg(F.ceil(2 * F.sum("bytes") / task_bytes).alias("shares"))
    pieces = rest.join(shares, ["low", "size"]).select("low", "size", "row", F.pmod(place, F.col("shares")).alias("share"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    whole = units.join(shares, ["low", "size"]).select("low", "size", "row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), "block")
    return found.unionByName(_linked(pieces.unionByName(whole), sets, "low", "size", "share", "block"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each near-duplicate component, with all columns.

    Null ids come last, ties and repeated rows go by position. Texts without words (empty, blank, null) are equal to each
    other; a text of fewer words than a shingle is one shingle. Texts of any length are taken whole. An empty table
    gives no rows; other columns pass through under any name. ``task_bytes`` bounds the sets a task compares at a time.
    """
    task_bytes = task_bytes or TASK_BYTES
    row = fresh(docs, "_row")
    numbered = settled(docs).withColumn(row, F.monotonically_increasing_id())
    base = numbered.select(F.col(row).alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("t"))
    searched = tree_search(numbered, id_col, text_col, row)
    stars = stored(candidate_stars(prefix_tokens(base)), "candidate-stars")
    parts = connected_components(stars, "row", "low")
    met = base.join(parts, base["row"] == parts["node"]).select("component", "row", "doc_id", "t")
    first = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")
    sets = met.mapInArrow(_sets, "component bigint, row bigint, doc_id bigint, digest binary, shingles binary")
    folded = stored(sets.groupBy("component", "digest").agg(F.min(first).alias("first"), F.min("row").alias("row"), F.first("shingles").alias("shingles")).join(searched, "row"), "sets")
    weight = F.octet_length("shingles")
    heavy = stored(folded.groupBy("component").agg(F.sum(weight).alias("bytes")).filter(F.col("bytes") > task_bytes).select("component"), "large-components")
    light = folded.join(heavy, "component", "left_anti").groupBy("component").applyInArrow(_lowest, "row bigint")
    if not heavy.isEmpty():
        large = folded.join(heavy, "component", "left_semi").select("component", "row", "first", "shingles", "near", weight.cast("bigint").alias("bytes"), (weight / 8).alias("n"))
        close = tree_links(large, task_bytes)
        grouped = large.join(close, "row", "left").select(*large.columns, F.coalesce("low", "row").alias("group"))
        # a component that trees have settled is one group
        apart = stored(grouped.groupBy("component").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("component"), "open-components")
        links = close.unionByName(star_links(grouped.join(apart, "component", "left_semi"), stars, task_bytes))
        groups = connected_components(stored(links, "links"), "row", "low")
        groups = groups.select(F.col("node").alias("row"), F.col("component").alias("group"))
        low = large.join(groups, "row", "left").groupBy(F.coalesce("group", "row").alias("group")).agg(F.min("first")["row"].alias("row"))
        light = light.unionByName(low.select("row"))
    gone = stored(parts.select(F.col("node").alias(row)).join(light.select(F.col("row").alias(row)), row, "left_anti"), "near-copies")
    return numbered.join(gone, row, "left_anti").drop(row)
