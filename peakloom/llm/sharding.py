"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 in the order of (id, checksum, size): a range partitioning, a local
position, and an offset per partition. The number is permuted by a keyed Feistel network over
Z_a x Z_b with a*b just above n; a value outside 0..n-1 walks on until it is inside. The permuted
number p gives shard p mod s and slot p div s, so any reader can compute where row r is, and which
row is in a slot, without the data. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.llm.common import stored, text_bytes

SHARDS, SEED, ROUNDS = 8, 2024, 6
#: At most sqrt(n) of the a*b values lie outside, so eight steps outside in a row are next to impossible; then the query fails loudly.
WALKS = 8


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, -(-n // a) if n else 1


def _round_key(seed: int, i: int) -> int:
    return seed * 1_000_003 + i


def _hash_long(value: int, key: int) -> int:
    """Spark's xxhash64(value, key) for two bigints."""
    pack = lambda v: (v & (2**64 - 1)).to_bytes(8, "little")
    h = xxhash.xxh64_intdigest(pack(key), xxhash.xxh64_intdigest(pack(value), 42))
    return h - 2**64 if h >= 2**63 else h


def locate(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    a, b = _sides(n)
    x = number
    while True:
        left, right = x // b, x % b
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + _hash_long(right, _round_key(seed, i)) % a) % a
            else:
                right = (right + _hash_long(left, _round_key(seed, i)) % b) % b
        x = left * b + right
        if x < n:
            return x % shards, x // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number in a slot of a shard: the inverse of ``locate``."""
    a, b = _sides(n)
    x = slot * shards + shard
    while True:
        left, right = x // b, x % b
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                left = (left - _hash_long(right, _round_key(seed, i)) % a) % a
            else:
                right = (right - _hash_long(left, _round_key(seed, i)) % b) % b
        x = left * b + right
        if x < n:
            return x


def permuted(df: DataFrame, number: str, n: int, seed: int = SEED, out: str = "p") -> DataFrame:
    """Add ``out``: the permuted value of ``number`` in 0..n-1."""
    a, b = _sides(n)
    cols = df.columns
    df = df.select(*cols, F.col(number).alias(out))
    for walk in range(WALKS):
        inside = (F.col(out) < n) if walk else F.lit(False)
        df = df.select(*cols, out, F.expr(f"{out} div {b}L").alias("_l"), (F.col(out) % b).alias("_r"))
        for i in range(ROUNDS):
            side, other, m = ("_l", "_r", a) if i % 2 == 0 else ("_r", "_l", b)
            step = (F.col(side) + F.pmod(F.xxhash64(F.col(other), F.lit(_round_key(seed, i)).cast("bigint")), F.lit(m))) % m
            df = df.select(*cols, out, F.col(other), step.alias(side))
        df = df.select(*cols, F.when(inside, F.col(out)).otherwise(F.col("_l") * b + F.col("_r")).alias(out))
    late = F.raise_error(F.lit("a row number did not come back inside its range"))
    return df.select(*cols, F.when(F.col(out) < n, F.col(out)).otherwise(late).cast("bigint").alias(out))


def row_numbers(df: DataFrame, order: list[str], out: str = "number") -> tuple[DataFrame, int]:
    """Add a gapless row number in a global order and return the row count.

    Rows are stored range-partitioned with their local position; the only small table is one offset
    per partition. Equal rows are interchangeable.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = stored(ranged, "numbered")
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    n = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of the range sort, so the hint has a known bound
    numbered = ranged.join(F.broadcast(offsets), part == F.col("_part"))
    return numbered.select(*df.columns, (local + F.col("_offset")).alias(out)), n


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, number, shard, slot, grown_shard) of every row.

    The law is ``rows``: shard sizes differ by one at most and slots are gapless from 0. A null text
    counts as empty, null ids come first, repeated rows get a slot each, an empty table gives no rows.
    ``grown_shard`` is null: the place of a row depends on the row count. Other columns are not read.
    """
    data = text_bytes(text_col)
    slim = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(data).cast("bigint") + 1).alias("size"), F.crc32(data).alias("text_crc32")
    )
    numbered, n = row_numbers(slim, ["doc_id", "text_crc32", "size"])
    placed = permuted(numbered, "number", n, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "number",
        (F.col("p") % shards).cast("int").alias("shard"), F.expr(f"p div {shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, rows_per_file: int = 1_000_000) -> None:
    """Write whole rows below ``path`` as shard=k/part-*, in slot order within ranges of slots.

    Needs unique ids. Ranges of (shard, slot) are dealt to tasks, so a shard is never one task's work.
    """
    places = shard_rows(docs, shards, seed).select(F.col("doc_id").alias("_id"), "shard", "slot")
    joined = docs.join(places, docs["doc_id"].eqNullSafe(places["_id"])).drop("_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
