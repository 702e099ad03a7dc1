"""Ranked sequence solutions and search hits of a spectrum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from peakloom.functions import mass
from peakloom.functions.band import with_neighbours
from peakloom.functions.ordered import row_numbers
from peakloom.session import cut_lineage

KEY = "spectrum_id"
SOLUTION_ORDER = lambda: [F.col("score").desc(), F.col("seq"), F.col("n_mass_u"), F.col("charge")]


def unique_solutions(solutions: DataFrame, tol: int) -> DataFrame:
    """Drop a solution when a better one has the same sequence and nearly the same start mass."""
    rows = solutions.distinct()
    me = lambda s, n, c: F.struct((-s).alias("a"), n.alias("b"), c.alias("c"))
    item = me(F.col("score"), F.col("n_mass_u"), F.col("charge"))
    near = with_neighbours(rows, [KEY, "seq"], "n_mass_u", -tol, tol, F.min(item))
    return near.filter(F.col("near") == item).select(*rows.columns)


def topk_solutions(solutions: DataFrame, k: int, tol: int) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(KEY).orderBy(*SOLUTION_ORDER()))
    return unique_solutions(solutions, tol).withColumn("rank", rn.cast("bigint")).filter(F.col("rank") <= k)


def best_solution(solutions: DataFrame) -> DataFrame:
    """The first solution of each spectrum as a map-side aggregate."""
    order = F.struct(
        (-F.col("score")).alias("neg"), "seq", F.col("n_mass_u").alias("n_mass_u"), F.col("charge").alias("charge")
    )
    return solutions.groupBy(KEY).agg(F.min(order).alias("top"))


def delta_score(solutions: DataFrame) -> DataFrame:
    best = solutions.groupBy(KEY).agg(F.max("score").alias("best"))
    return solutions.join(best, KEY).withColumn("delta", F.col("best") - F.col("score")).drop("best")


def single_charge_solutions(solutions: DataFrame) -> DataFrame:
    top = best_solution(solutions).select(KEY, F.col("top.charge").alias("charge"))
    return solutions.join(top, [KEY, "charge"], "left_semi")


def _prefix_masses(seq: str) -> list[int | None]:
    """As ``prefix_mass_array``: a letter without a mass has none, and the next one starts anew."""
    out: list[int | None] = []
    for letter in seq or " ":
        own = mass.RESIDUE_MASS.get(letter)
        out.append(None if own is None else ((out and out[-1]) or 0) + own)
    return out


def _shares(pairs: list[tuple[str, str | None]], tol: int) -> np.ndarray:
    """Share of the cuts of the first of each pair that the second also has, for all pairs together."""
    cuts = {seq: _prefix_masses(seq) for seq in {s for p in pairs for s in p if s is not None}}

    def flat(place: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [[m for m in cuts.get(p[place], ()) if m is not None] for p in pairs]
        return np.array([m for row in rows for m in row], np.int64), np.repeat(np.arange(len(rows)), list(map(len, rows)))

    (mine, of), (theirs, by) = flat(0), flat(1)
    span = max(mine.max(initial=0), theirs.max(initial=0)) + 2 * tol + 1
    at, seen = mine + of * span, np.sort(theirs + by * span)
    hit = np.searchsorted(seen, at + tol, "right") > np.searchsorted(seen, at - tol, "left")
    return np.bincount(of, hit, len(pairs)) / np.array([len(cuts[a]) for a, _ in pairs])


def _coded(texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """The different texts, null last, and the place of each one among them."""
    names = texts.dictionary_encode()
    return [*names.dictionary.to_pylist(), None], names.indices.fill_null(len(names.dictionary)).to_numpy().astype(np.int64)


def with_shared_cuts(rows: DataFrame, seq: str, other: str, tol: int) -> DataFrame:
    """Adds ``share``: of the cuts of ``seq`` those that ``other`` also has. Equal pairs of a batch are compared once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, codes = zip(*(_coded(batch.column(c)) for c in (seq, other)))
            both, place = np.unique(codes[0] * len(texts[1]) + codes[1], return_inverse=True)
            names = [(texts[0][i], texts[1][j]) for i, j in zip(*(x.tolist() for x in divmod(both, len(texts[1]))))]
            known = np.array([a is not None for a, _ in names], bool)
            share = np.zeros(len(names))
            share[known] = _shares([p for p in names if p[0] is not None], tol)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(share[place], mask=~known[place])], names=[*batch.schema.names, "share"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "share double"]))


def recalibrate_hits(hits: DataFrame, tol: int, same_share: float = 0.8) -> DataFrame:
    """Rank by score; the top hit's delta is to the second, any other's to the top. The top
    also gets its delta to the best hit that is not nearly the same sequence. Hits and ranks are
    stored, as each is used several times."""
    best = cut_lineage(hits.groupBy(KEY, "seq").agg(F.max("score").alias("score")))
    bucket = -F.floor(F.col("score") / 64)
    ranked = cut_lineage(row_numbers(best, [KEY], bucket, [F.col("score").desc(), F.col("seq")], "rank"))
    top = ranked.filter("rank = 1").select(KEY, F.col("seq").alias("top_seq"), F.col("score").alias("top_score"))
    joined = ranked.join(top, KEY)
    others = (
        with_shared_cuts(joined.filter("rank > 1").select(KEY, "seq", "top_seq", "score"), "seq", "top_seq", tol)
        .groupBy(KEY)
        .agg(F.max("score").alias("second"), F.max(F.when(F.col("share") < same_share, F.col("score"))).alias("other"))
    )
    first = F.col("rank") == 1
    return joined.join(others, KEY, "left").select(
        KEY,
        "seq",
        "score",
        "rank",
        F.when(first, F.col("score") - F.coalesce("second", F.lit(0))).otherwise(F.col("score") - F.col("top_score")).alias("delta"),
        F.when(first, F.col("score") - F.coalesce("other", F.lit(0))).alias("delta_other"),
    )


def cumulative_monotone(ranked: DataFrame, prob: str, rank: str = "rank") -> DataFrame:
    """Running maximum by rank; ``ranked`` holds at most k rows per spectrum."""
    up = W.partitionBy(KEY).orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("cum_prob", F.max(prob).over(up))
