"""Removal of long repeated strings by merging Burrows-Wheeler transforms.

A byte goes when a string of ``LENGTH`` bytes that covers it starts anywhere else, too. Sorting all
suffixes of a corpus is out of reach, so the suffixes that cannot matter are shed first, exactly:

1. Every window of ``LENGTH`` bytes has an anchor, the place of its smallest ``GRAM``-byte hash, which
   only depends on its bytes. Equal windows have equal anchors at equal offsets, so windows whose anchor
   hash is met once in the corpus are unique. Hashes are counted with map-side aggregation.
2. Neighbouring windows with one anchor form a *context*, the stretch of text they cover. Contexts with
   a repeated anchor are counted by a 128-bit hash; one that is met twice is repeated as a whole. Only
   where an anchor has several different contexts are their bytes needed, each once.
3. The different contexts of an anchor meet in one task and are cut into shards. Each shard gets its
   Burrows-Wheeler transform; the transforms are merged by refining the interleave of all shards: the
   suffixes in the order of their first k bytes, put stably into the order of the symbols before them,
   are the suffixes in the order of their first k+1 bytes (several symbols are taken in one round). Blocks
   of a common prefix are kept alongside, a block of one suffix is dropped with all that would precede
   it, and the blocks left at depth ``LENGTH`` are the repeated intervals. No suffix is compared again.
4. Runs of repeated windows go back to the places of their contexts and to the documents.

An anchor with many contexts has them trimmed first to what they share with their neighbours in the
sorted order on either side of the anchor; outside of it no window is repeated. Should they still be
too many for one merge, or should the anchor have more than ``HOT_SPOTS`` places, the windows are counted
one by one by a 128-bit hash, with map-side aggregation, so no task ever holds such a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from peakloom.llm.common import settled, stored, text_bytes

LENGTH, GRAM = 200, 64
CHUNK = 1 << 18
BATCH_BYTES, SHARD_BYTES, ORDERED = 1 << 19, 1 << 17, 64
HOT_SPOTS = 1 << 17
#: Different contexts of one anchor from which they are trimmed, and bytes of them beyond which their windows are counted.
LARGE, MOST_BYTES = 1 << 12, 6 << 20
#: Repeated anchor hashes are sent to the tasks as a bitmap of this size (8 MB) while there are at most FILTER_MAX; beyond, they are joined.
FILTER_BITS, FILTER_MAX = 26, 1 << 23

_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)


def _multipliers(n: int, seed: int) -> list[np.uint64]:
    rng = np.random.default_rng(seed)
    return [np.uint64(int(x) | 1) for x in rng.integers(1, 2**63, n)]


_ODD = _multipliers(8, 5)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[6]
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (a power of two) bytes from every place."""
    h = data.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < size:
        h = h[:-step] * _ODD[step.bit_length() - 1] + h[step:]
        step *= 2
    return _mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def contexts(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, anchor hash) of all contexts of the documents in one buffer."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < length:
        return none
    h = gram_hashes(data, gram)
    least = _sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    anchor = (least & _PLACE).astype(np.int64)
    windows = np.maximum(size - length + 1, 0)
    doc = np.repeat(np.arange(len(begin)), windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[doc]
    if not len(start):
        return none
    at = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return doc[first], start[first], start[last], at[first], h[at[first]]


def chunks(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, text index, begin, size, offset in the text) of groups of texts; a very long text comes in pieces that
    overlap by length - 1, so that each window is in exactly one."""
    group: list[tuple[int, int, bytes]] = []
    total = 0
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), CHUNK):
            piece = text[a : a + CHUNK + length - 1] if len(text) > CHUNK else text
            if len(piece) < length:
                continue
            group.append((i, a, piece))
            total += len(piece)
            if total >= CHUNK:
                yield _buffer(group)
                group, total = [], 0
    if group:
        yield _buffer(group)


def _buffer(group):
    size = np.array([len(p) for _, _, p in group])
    return np.frombuffer(b"".join([p for _, _, p in group]), np.uint8), np.array([i for i, _, _ in group]), np.cumsum(size) - size, size, np.array([a for _, a, _ in group])


def shard_transform(data: np.ndarray, depth: int = ORDERED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, step to the preceding suffix, suffix order) of a shard: strings of symbols above 0, each ended by a 0.

    The suffixes are ordered by prefix doubling over their first ``depth`` symbols.
    """
    n = len(data)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key, width = wide[:n], 1
    for i in range(1, 8):
        key = key << np.uint64(8) | wide[i : n + i]
    width = 8
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if width >= depth or fresh[-1] == n - 1:
            break
        rank = np.empty(n + width, np.uint64)
        rank[order] = fresh + 1
        rank[n:] = 0
        key = rank[:n] << np.uint64(32) | rank[width:]
        width *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(order > 0, order - 1, n - 1)
    return data[before], place[before], order


def merged_intervals(shards: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each shard the places from which ``length`` symbols are met at another place of any shard."""
    parts = [shard_transform(s) for s in shards]
    base = np.cumsum([0, *(len(s) for s in shards)])
    one = np.concatenate([p[0] for p in parts])
    step = np.concatenate([p[1] + b for p, b in zip(parts, base)]).astype(np.int32)
    order = np.concatenate([p[2] + b for p, b in zip(parts, base)])
    # the symbols before each suffix, the farthest in the highest bits; none where a string begins among them
    bits = len(one).bit_length()
    taken = max(k for k in range(1, (64 - bits) // 8 + 1) if length % k == 0)
    symbols, inside, jump = np.zeros(len(one), np.uint64), np.ones(len(one), bool), np.arange(len(one), dtype=np.int32)
    for k in range(taken):
        symbol = one[jump]
        symbols |= symbol.astype(np.uint64) << np.uint64(bits + 8 * k)
        inside &= symbol > 0
        jump = step[jump]
    symbols[~inside] = 0
    number = np.arange(len(one), dtype=np.uint64)
    low = np.uint64((1 << bits) - 1)
    # the interleave: suffixes of all shards by their first k symbols, and the block of equal prefixes each is in
    at, block = np.arange(len(one), dtype=np.int32), np.zeros(len(one), np.int32)
    for _ in range(length // taken):
        # with its place in the present order below them, the symbols sort stably
        key = np.sort(symbols[at] | number[: len(at)])
        key = key[np.searchsorted(key, low, "right") :]
        kind = (key & low).astype(np.int32)
        key >>= np.uint64(bits)
        at, block = jump[at[kind]], block[kind]
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(edge[:-1], dtype=np.int32)
        shared = ~(edge[:-1] & edge[1:])
        if not shared.all():
            at, block = at[shared], block[shared]
        if not len(at):
            break
    found = np.sort(order[at])
    cut = np.searchsorted(found, base)
    return [found[a:b] - s for a, b, s in zip(cut, cut[1:], base)]


class Repeats:
    """Repeated windows of the contexts of whole anchors, several anchors to a merge."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length, self.groups, self.bytes = length, [], 0

    def add(self, strings: dict[bytes, int]) -> None:
        """Different strings of one anchor, with how often each is met."""
        self.groups.append(strings)
        self.bytes += sum(map(len, strings))

    def runs(self) -> Iterator[dict[bytes, tuple[list[int], list[int]]]]:
        """For each group added, in order: string -> (firsts, lasts) of its runs of repeated windows."""
        found: dict[tuple[int, bytes], np.ndarray] = {}
        shards: list[list[tuple[int, bytes]]] = []
        room = 0
        for g, strings in enumerate(self.groups):
            for s in strings:
                if room <= 0:
                    shards.append([])
                    room = SHARD_BYTES
                shards[-1].append((g, s))
                room -= len(s)
        coded = [np.frombuffer(b"\xff".join([*(s for _, s in shard), b""]), np.uint8) + np.uint8(1) for shard in shards]
        for shard, places in zip(shards, merged_intervals(coded, self.length) if shards else []):
            begin = np.cumsum([0, *(len(s) + 1 for _, s in shard)])
            cut = np.searchsorted(places, begin)
            for key, a, b, start in zip(shard, cut, cut[1:], begin):
                found[key] = places[a:b] - start
        for g, strings in enumerate(self.groups):
            out = {}
            for s, n in strings.items():
                at = found[g, s]
                if n > 1:
                    out[s] = [0], [len(s) - self.length]
                elif len(at):
                    edge = np.flatnonzero(np.diff(at) > 1)
                    out[s] = [int(at[0]), *at[edge + 1].tolist()], [*at[edge].tolist(), int(at[-1])]
            yield out
        self.groups, self.bytes = [], 0


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax())


def _shared(parts: list[bytes]) -> list[int]:
    """Longest common prefix of each part with any other: that with a neighbour in sorted order."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def trimmed(strings: list[bytes], anchors: list[int], length: int) -> list[tuple[int, bytes]]:
    """(offset, rest) of each string: outside of the rest it has no window that another string has.

    Equal windows have their anchor at one offset, so they reach as far to its left and right as both.
    """
    left = _shared([s[:a][::-1] for s, a in zip(strings, anchors)])
    right = _shared([s[a:] for s, a in zip(strings, anchors)])
    return [(a - x, s[a - x : a + y] if x + y >= length else b"") for s, a, x, y in zip(strings, anchors, left, right)]


_RUNS = pa.schema(
    [("h", pa.int64()), ("c", pa.int64()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("w1", pa.int64()), ("w2", pa.int64()), ("at", pa.int32())]
)
_RUNS_SQL = "h bigint, c bigint, first array<int>, last array<int>, w1 bigint, w2 bigint, at int"


def _windows(rows: list[tuple[int, int, bytes]], length: int) -> pa.RecordBatch:
    """A row for every window of the contexts, with two independent hashes of its bytes."""
    h, c, w1, w2, at = [], [], [], [], []
    for key, digest, s in rows:
        for i in range(len(s) - length + 1):
            d = hashlib.md5(s[i : i + length]).digest()
            h.append(key)
            c.append(digest)
            w1.append(int.from_bytes(d[:8], "little", signed=True))
            w2.append(int.from_bytes(d[8:], "little", signed=True))
            at.append(i)
    cols = [h, c, [None] * len(h), [None] * len(h), w1, w2, at]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _RUNS)], schema=_RUNS)


def _merge(length: int, large: int, most_bytes: int):
    """Classes arrive sorted by anchor hash: rows (h, c, off, hot, ctx)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, waiting = Repeats(length), []

        def settle():
            out = []
            for (key, members), runs in zip(waiting, list(repeats.runs())):
                for digest, offset, s in members:
                    if s in runs:
                        first, last = runs[s]
                        out.append((key, digest, [offset + x for x in first], [offset + x for x in last], None, None, None))
            waiting.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _RUNS)], schema=_RUNS)

        def close(key, own: dict[bytes, tuple[int, int]]):
            members = [(digest, 0, s) for s, (digest, _) in own.items()]
            if len(own) > large:
                rest = trimmed(list(own), [a for _, a in own.values()], length)
                members = [(m[0], offset, s) for m, (offset, s) in zip(members, rest) if s]
            strings: dict[bytes, int] = {}
            for _, _, s in members:
                strings[s] = strings.get(s, 0) + 1
            if sum(map(len, strings)) > most_bytes:
                full = list(own.items())
                for a in range(0, len(full), 256):
                    yield _windows([(key, d, s) for s, (d, _) in full[a : a + 256]], length)
                return
            repeats.add(strings)
            waiting.append((key, members))
            if repeats.bytes >= BATCH_BYTES:
                yield from settle()

        now, own, lone = None, {}, []
        for batch in batches:
            for key, digest, off, hot, s in zip(*(c.to_pylist() for c in batch.columns)):
                if hot:
                    lone.append((key, digest, s))
                    if len(lone) >= 256:
                        yield _windows(lone, length)
                        lone = []
                    continue
                if key != now:
                    if own:
                        yield from close(now, own)
                    now, own = key, {}
                own[s] = digest, off
        if own:
            yield from close(now, own)
        yield from settle()
        if lone:
            yield _windows(lone, length)

    return run


class Bitmap:
    """A set of 64-bit values by their upper bits: never misses, may hold more."""

    def __init__(self, values: DataFrame, column: str) -> None:
        shift = 64 - FILTER_BITS
        top = F.shiftrightunsigned(column, shift)
        rows = values.select(F.shiftright(top, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {shift}) & 63 as int))").alias("bit"))
        words = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**(FILTER_BITS - 6) rows
        self.words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    def has(self, values: np.ndarray) -> np.ndarray:
        top = values.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
        return (self.words.view(np.uint64)[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) == 1


def _xx_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of one 64-bit integer each, as Spark's xxhash64 chains them."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = seed + p5 + np.uint64(8)
    h = turn(h ^ (turn(value * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def spot_hash(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """xxhash64(row, start) of two bigint columns."""
    return _xx_long(start.astype(np.int64).view(np.uint64), _xx_long(row.astype(np.int64).view(np.uint64), np.full(len(row), 42, np.uint64))).view(np.int64)


def _scan(batches: Iterable[pa.RecordBatch], length: int, gram: int):
    """(texts, text index, start, windows, anchor offset, anchor hash, wanted sets) of the contexts of each batch."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        rows = batch.column(0).to_numpy()
        wanted = batch.column(2).to_pylist() if batch.num_columns > 2 else None
        for data, index, begin, size, offset in chunks(texts, length):
            doc, first, last, anchor, h = contexts(data, begin, size, length, gram)
            shift = offset[doc] - begin[doc]
            yield texts, rows, wanted, index[doc], first + shift, last - first + 1, anchor - first, h.view(np.int64)


def _count(length: int, gram: int):
    def run(batches):
        for _, _, _, _, _, _, _, h in _scan(batches, length, gram):
            values, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["h", "n"])

    return run


def _chosen(wanted, bitmap, values, index):
    """Contexts whose value is in the bitmap, or in the joined list of their document."""
    if bitmap is not None:
        return bitmap.value.has(values)
    keep = np.zeros(len(values), bool)
    for i in np.unique(index):
        own = index == i
        keep[own] = np.isin(values[own], np.array(wanted[i] or [], np.int64))
    return keep


def _spots(length: int, gram: int, bitmap):
    def run(batches):
        from xxhash import xxh64_intdigest as digest

        for texts, rows, wanted, index, start, n, _, h in _scan(batches, length, gram):
            keep = _chosen(wanted, bitmap, h, index)
            index, start, n, h = index[keep], start[keep], n[keep], h[keep]
            c = np.fromiter((digest(texts[i][s : s + k + length - 1]) for i, s, k in zip(index.tolist(), start.tolist(), n.tolist())), np.uint64, len(index))
            yield pa.RecordBatch.from_arrays([pa.array(rows[index]), pa.array(start), pa.array(n), pa.array(h), pa.array(c.view(np.int64))], names=["row", "start", "n", "h", "c"])

    return run


def _contents(length: int, gram: int, bitmap, hot):
    def run(batches):
        from xxhash import xxh64_intdigest as digest

        for texts, rows, wanted, index, start, n, off, h in _scan(batches, length, gram):
            keep = _chosen(wanted, bitmap, spot_hash(rows[index], start), index)
            index, start, n, off, h = index[keep], start[keep], n[keep], off[keep], h[keep]
            s = [texts[i][a : a + k + length - 1] for i, a, k in zip(index.tolist(), start.tolist(), n.tolist())]
            c = np.fromiter(map(digest, s), np.uint64, len(s)).view(np.int64)
            single = hot.value.has(h) if hot is not None else np.zeros(len(h), bool)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(off), pa.array(single), pa.array(s, pa.binary())], names=["h", "c", "off", "hot", "ctx"])

    return run


def _with_wanted(base: DataFrame, values: DataFrame, column: str, rows: DataFrame, most: int) -> tuple[DataFrame, object]:
    """The scan that finds ``values`` again: by a bitmap of fixed size, or beyond ``most`` values joined to their rows."""
    if values.count() <= most:
        return base, base.sparkSession.sparkContext.broadcast(Bitmap(values, column))
    lists = rows.groupBy("row").agg(F.collect_set(column).alias("wanted"))  # bounded by the document
    return base.join(lists, "row", "left").select("row", "t", "wanted"), None


def dealt(contents: DataFrame) -> DataFrame:
    """The contexts of an anchor that are merged in one task, those of a hot one, which need no common task, over all."""
    return contents.repartition("h", F.when(F.col("hot"), F.col("c")))


def repeated_runs(
    base: DataFrame, length: int = LENGTH, gram: int = GRAM, filter_max: int = FILTER_MAX, hot_spots: int = HOT_SPOTS, large: int = LARGE, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """(row, first, last): runs of windows, by their starts, that are met elsewhere too; ``base`` is (row, t)."""
    counts = base.mapInArrow(_count(length, gram), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = stored(counts.filter("n > 1").select("h", (F.col("n") > hot_spots).alias("hot")), "anchors")
    hot = repeated.filter("hot").select("h")
    if repeated.count() <= filter_max:
        scan, bitmap = base, base.sparkSession.sparkContext.broadcast(Bitmap(repeated, "h"))
    else:
        places = base.mapInArrow(_places(length, gram), "row bigint, h bigint").join(repeated.select("h"), "h")
        scan, bitmap = _with_wanted(base, repeated, "h", places, -1)
    spots = stored(scan.mapInArrow(_spots(length, gram, bitmap), "row bigint, start bigint, n bigint, h bigint, c bigint"), "spots")
    # the different contexts: how often, and one spot where each is found
    forms = spots.groupBy("h", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.xxhash64("row", "start")).alias("spot"))
    by_anchor = stored(forms, "contexts")
    several = by_anchor.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h")
    needed = stored(by_anchor.join(several, "h").select("spot"), "needed")
    found_at = spots.withColumn("spot", F.xxhash64("row", "start")).join(needed.select("spot"), "spot", "left_semi").select("row", "spot")
    scan, bitmap = _with_wanted(base, needed, "spot", found_at, filter_max)
    # which anchors are hot is kept as a bitmap of fixed size, too: one more that it holds only takes the other exact way
    single = base.sparkSession.sparkContext.broadcast(Bitmap(hot, "h")) if hot.head(1) else None
    contents = scan.mapInArrow(_contents(length, gram, bitmap, single), "h bigint, c bigint, off bigint, hot boolean, ctx binary")
    merged = stored(dealt(contents).sortWithinPartitions("h").mapInArrow(_merge(length, large, most_bytes), _RUNS_SQL), "runs")
    # windows that were counted one by one; a context may be delivered more than once, a window counts once a place
    single = merged.filter("w1 is not null").select("h", "c", "w1", "w2", "at").distinct()
    twice = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("w1", "w2")
    listed = single.join(twice, ["w1", "w2"]).select("h", "c", F.col("at").alias("first"), F.col("at").alias("last"))
    runs = merged.filter("w1 is null").dropDuplicates(["h", "c"]).select("h", "c", F.explode(F.arrays_zip("first", "last")).alias("r")).select("h", "c", "r.first", "r.last")
    whole = by_anchor.filter("times > 1").select("h", "c", F.lit(0).alias("first"), F.lit(None).cast("int").alias("last"))
    once = by_anchor.filter("times = 1").select("h", "c")
    verdicts = whole.unionByName(runs.unionByName(listed).join(once, ["h", "c"], "left_semi"))
    # a context that is repeated as a whole takes its last window from the spot
    return spots.join(verdicts, ["h", "c"]).select("row", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.coalesce("last", F.col("n") - 1)).alias("last"))


def _places(length: int, gram: int):
    def run(batches):
        for _, rows, _, index, _, _, _, h in _scan(batches, length, gram):
            yield pa.RecordBatch.from_arrays([pa.array(rows[index]), pa.array(h)], names=["row", "h"])

    return run


def row_hash(row: np.ndarray) -> np.ndarray:
    """xxhash64(row) of a bigint column."""
    return _xx_long(row.astype(np.int64).view(np.uint64), np.full(len(row), 42, np.uint64)).view(np.int64)


def _texts(bitmap, inside: bool):
    """(doc_id, row, t) of the rows that the bitmap has, or of the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.value.has(row_hash(batch.column(1).to_numpy())) == inside))

    return run


def _removed(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, firsts, lasts, kept = [], [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                first, last, rest, at = [], [], [], 0
                for a, b in sorted((r["first"], r["last"] + length) for r in runs or ()):
                    if last and a <= last[-1]:
                        last[-1] = max(last[-1], b)
                    else:
                        first.append(a)
                        last.append(b)
                for a, b in zip(first, last):
                    rest.append(text[at:a])
                    at = b
                sizes.append(len(text))
                firsts.append(first)
                lasts.append(last)
                kept.append(b"".join([*rest, text[at:]]))
            spans = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(firsts, spans), pa.array(lasts, spans), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "first", "last", "kept"],
            )

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_bytes, first, last, kept) of every row.

    ``first`` and ``last`` bound the maximal removed runs (end exclusive), ``kept`` is what remains, as bytes:
    a run may begin or end inside a character. Strings are judged on the input and never cross rows. Null
    texts are empty; texts shorter than ``length`` stay; repeated rows remove each other whole; null and
    repeated ids pass through; an empty table gives no rows; other columns are not read.
    """
    base = settled(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_bytes(text_col).alias("t"))
    runs = repeated_runs(base.select("row", "t"), length, **options)
    lists = stored(runs.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "run-lists")  # bounded by the document
    # only texts that have runs are shuffled to them; the bitmap may send a few others along
    bitmap = docs.sparkSession.sparkContext.broadcast(Bitmap(lists.select(F.xxhash64("row").alias("v")), "v"))
    some, rest = (base.mapInArrow(_texts(bitmap, inside), "doc_id bigint, row bigint, t binary") for inside in (True, False))
    none = F.lit(None).cast(lists.schema["runs"].dataType)
    joined = some.join(lists, "row", "left").select("doc_id", "t", "runs").unionByName(rest.select("doc_id", "t", none.alias("runs")))
    return joined.mapInArrow(_removed(length), "doc_id bigint, n_bytes bigint, first array<bigint>, last array<bigint>, kept binary")
