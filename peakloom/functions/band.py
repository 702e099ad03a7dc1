"""Tolerance joins and neighbourhood windows inside a key.

Spark has no range-join strategy, so an interval is turned into a bounded set of bucket
ids and joined by equality on (key, bucket). The point side has exactly one bucket, so
each pair appears once. A hot key is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bucket_of(value: Column, width: int) -> Column:
    return F.floor(value / width).cast("bigint")


def band_join(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    lo: Column,
    hi: Column,
    point: str,
    width: int,
    how: str = "inner",
    parts: int | None = None,
) -> DataFrame:
    """Pairs with equal ``keys`` and ``lo <= point <= hi``.

    Column names of the two sides must differ apart from ``keys``. ``how`` is inner,
    left_semi or left_anti; the outer forms need an interval side unique on its columns.

    Spark does not count what an explode adds to a side, so by its estimate a small table that is
    laid out to many intervals would be sent whole to the driver and to each task: the sides are
    sorted and merged instead. ``parts``: of the sides, where the session's number would let a part grow with the table.
    """
    keys = list(keys)
    probe = intervals.select("*", lo.alias("_lo"), hi.alias("_hi"))
    exploded = probe.select("*", F.explode(F.sequence(bucket_of(F.col("_lo"), width), bucket_of(F.col("_hi"), width))).alias("_b"))
    right = points.select("*", bucket_of(F.col(point), width).alias("_b"))
    if parts:
        exploded, right = (side.repartition(parts, *keys, "_b") for side in (exploded, right))
    inner = exploded.hint("merge").join(right, keys + ["_b"]).filter(F.col(point).between(F.col("_lo"), F.col("_hi")))
    if how == "inner":
        return inner.drop("_b", "_lo", "_hi")
    matched = inner.select(*intervals.columns).distinct()
    return intervals.join(matched, intervals.columns, how)


def in_chunks(points: DataFrame, at: str, lo: int, hi: int, spread: int) -> DataFrame:
    """Lay each point out to the mass chunks that see it at ``at + [lo, hi]``; ``_home`` marks its own chunk."""
    size = spread * max(abs(lo), abs(hi), 1)
    first = bucket_of(F.col(at) - max(hi, 0), size)
    last = bucket_of(F.col(at) - min(lo, 0), size)
    laid = points.select("*", F.explode(F.sequence(first, last)).alias("_chunk"))
    return laid.withColumn("_home", F.col("_chunk") == bucket_of(F.col(at), size))


def larger_in_ranges(value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each i the number of j in begin[i] .. end[i] - 1 with value[j] > value[i].

    One stable partition by each bit of the ranks, the highest first; all counts follow at once, so the
    time is that of a sort however many values a range holds.
    """
    levels, own = np.unique(value, return_inverse=True)
    lo, hi, total, row = begin.astype(np.int64), end.astype(np.int64), np.zeros(len(value), np.int64), own
    for bit in reversed(range(max(1, int(len(levels) - 1).bit_length()))):
        zero = (row >> bit) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        at, to = zeros[lo], zeros[hi]
        low = (own >> bit) & 1 == 0
        total += np.where(low, (hi - lo) - (to - at), 0)
        lo, hi = np.where(low, at, zeros[-1] + lo - at), np.where(low, to, zeros[-1] + hi - to)
        row = np.concatenate([row[zero], row[~zero]])
    return total


class RangeMax:
    """Place of the largest value of ranges, the first of equals: tables of maxima over spans of 1, 2, 4 .. places."""

    def __init__(self, value: np.ndarray) -> None:
        self.value, self.tables = value, [np.arange(len(value))]
        while 2 << (len(self.tables) - 1) <= len(value):
            half, last = 1 << (len(self.tables) - 1), self.tables[-1]
            self.tables.append(self._larger(last[:-half], last[half:]))

    def _larger(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.value[b] > self.value[a], b, a)

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each range begin .. end - 1 the place; -1 where it is empty."""
        out = np.full(len(begin), -1)
        size = end - begin
        for k, table in enumerate(self.tables):
            own = np.flatnonzero((size >> k) == 1)
            if len(own):
                out[own] = self._larger(table[begin[own]], table[end[own] - (1 << k)])
        return out


def by_chunk(
    points: DataFrame, key: str, at: str, lo: int, hi: int, measure, added: dict[str, str], spread: int = 4, given: Sequence[str] | None = None, valid: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add columns that ``measure`` finds from all points of a key around each point.

    ``measure(place, columns)`` gets the points of whole chunks, several at a time: ``place`` rises with
    the position, and points of different chunks are out of reach of each other there. It returns one
    numpy or Arrow array for each name in ``added`` (name -> SQL type). One shuffle; a task holds one
    chunk at a time beyond its batch. Of the columns of ``points`` only those in ``given`` come back, and with
    ``valid`` only the rows in which that column, given or added, is not null. ``parts``: as in ``band_join``.
    """
    back = list(given or points.columns)
    laid = in_chunks(points, at, lo, hi, spread)
    schema = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in back), *(f"`{n}` {t}" for n, t in added.items())])
    reach, columns = max(abs(lo), abs(hi), 1), points.columns

    def measured(rows: pa.Table, breaks: np.ndarray) -> pa.Table:
        position = rows.column(at).to_numpy()
        group = np.cumsum(breaks)
        low = np.minimum.reduceat(position, np.flatnonzero(breaks))
        span = int((position - low[group - 1]).max()) + 2 * reach + 1
        found = measure(position - low[group - 1] + group * span, {c: rows.column(c) for c in columns})
        out = rows.select(back)
        for name, values in zip(added, found):
            out = out.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
        home = rows.column("_home")
        return out.filter(pc.and_(home, out.column(valid).is_valid()) if valid else home)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the chunk that is still open

        def settle(parts):
            rows = pa.Table.from_batches(parts)
            names, chunks = (rows.column(c).combine_chunks() for c in (key, "_chunk"))
            new = np.ones(len(rows), bool)
            new[1:] = pc.or_(pc.not_equal(names[1:], names[:-1]), pc.not_equal(chunks[1:], chunks[:-1])).to_numpy(zero_copy_only=False)
            yield from measured(rows, new).to_batches()

        for batch in batches:
            if not len(batch):
                continue
            names, chunks = batch.column(key), batch.column("_chunk")
            same = pc.and_(pc.equal(names, names[-1]), pc.equal(chunks, chunks[-1])).to_numpy(zero_copy_only=False)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut or (held and (held[-1].column(key)[-1] != names[0] or held[-1].column("_chunk")[-1] != chunks[0])):
                yield from settle([*held, batch.slice(0, cut)] if cut else held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from settle(held)

    ordered = (laid.repartition(parts, key, "_chunk") if parts else laid.repartition(key, "_chunk")).sortWithinPartitions(key, "_chunk", at)
    return ordered.mapInArrow(run, schema)


def with_match(rows: DataFrame, points: DataFrame, key: str, at: str, tol: int, name: str, spread: int = 32, parts: int | None = None) -> DataFrame:
    """Add the flag ``name``: is there a point of ``points`` (key, at) with the same key within ``tol``. No pair is laid out."""

    def measure(place, columns):
        point = columns["_point"].to_numpy()
        known = place[point]
        near = np.searchsorted(known, place + tol, "right") > np.searchsorted(known, place - tol, "left")
        return [pa.array(near, mask=point)]

    both = rows.withColumn("_point", F.lit(False)).unionByName(points.select(key, at, F.lit(True).alias("_point")), allowMissingColumns=True)
    return by_chunk(both, key, at, -tol, tol, measure, {name: "boolean"}, spread, rows.columns, name, parts)


def with_neighbours(points: DataFrame, key: str | Sequence[str], at: str, lo: int, hi: int, value: Column, name: str = "near", spread: int = 4) -> DataFrame:
    """Add the aggregate ``value`` over all points of the key at ``at + [lo, hi]`` (self included when the interval holds 0).

    Keys are cut into chunks of ``spread`` times the reach; each point also goes to the chunks that see it,
    so one shuffle serves all rows and no pair is written out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    frame = W.partitionBy(*keys, "_chunk").orderBy(at).rangeBetween(lo, hi)
    seen = in_chunks(points, at, lo, hi, spread).withColumn(name, value.over(frame))
    return seen.filter("_home").drop("_home", "_chunk")
