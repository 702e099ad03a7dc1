"""Exact deduplication by Grace hash partitioning.

1. Every scan task merges equal texts in an open-addressing table and flushes it when it is
   full, so a text that fills a third of the corpus leaves each task as a few rows. A flushed
   row (a *local class*) has the text once and the ids of its rows, at most ``max_ids``.
2. The local classes are shuffled by a hash of the text. Each bucket streams through a table of
   at most ``table_bytes`` of different texts; rows that do not fit go to spill files by the
   next bits of the hash and are settled the same way, level by level. Hashes only route:
   equality is always decided on the complete text.
3. Verdicts are joined back to the local classes by class number, and the ids unfold there;
   the ids of one text never meet in one task.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from peakloom.llm.common import SPACE, fresh, settled, stored

TABLE_BYTES = 32 << 20
MAX_IDS = 50_000
FAN_OUT_BITS = 4
OUT_ROWS, OUT_BYTES = 2_000, 8 << 20

_CLASSES = pa.schema(
    [("cls", pa.int64()), ("h", pa.int64()), ("content", pa.binary()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))]
)
_VERDICTS = pa.schema(
    [("cls", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())]
)


def normal_text(c: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    runs = rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+"  # runs that are not one space already
    return F.regexp_replace(F.coalesce(c, F.lit("")), runs, " ")


class ContentTable:
    """Open addressing with linear probing; a slot matches when the complete contents are equal."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _slot(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        i = (h ^ (h >> 29)) & mask
        while (k := self.slots[i]) >= 0 and not (self.hashes[k] == h and self.contents[k] == content):
            i = (i + 1) & mask
        return i

    def find(self, h: int, content: bytes) -> int:
        """Index of an equal content, or -1."""
        return self.slots[self._slot(h, content)]

    def add(self, h: int, content: bytes) -> int:
        """Index of a content that is not in the table yet."""
        if 2 * len(self.contents) >= len(self.slots):
            self.slots = array("q", [-1]) * (2 * len(self.slots))
            for k, (old, text) in enumerate(zip(self.hashes, self.contents)):
                self.slots[self._slot(old, text)] = k
        self.slots[self._slot(h, content)] = k = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        return k


def _local_classes(table_bytes: int, max_ids: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        table, ids, rows, n = ContentTable(), [], [], 0

        def flush():
            nonlocal number
            for a in range(0, len(ids), OUT_ROWS):
                b = min(a + OUT_ROWS, len(ids))
                cols = [list(range(number, number + b - a)), table.hashes[a:b], table.contents[a:b], ids[a:b], rows[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CLASSES)], schema=_CLASSES)
                number += b - a

        for batch in batches:
            for doc, row, h, content in zip(*(c.to_pylist() for c in batch.columns)):
                if n and (table.bytes + len(content) > table_bytes or n >= max_ids):
                    yield from flush()
                    table, ids, rows, n = ContentTable(), [], [], 0
                if (k := table.find(h, content)) < 0:
                    k = table.add(h, content)
                    ids.append([])
                    rows.append([])
                ids[k].append(doc)
                rows[k].append(row)
                n += 1
        yield from flush()

    return run


def _branch(h: int, level: int) -> int:
    return (h >> (FAN_OUT_BITS * level)) & ((1 << FAN_OUT_BITS) - 1)


def settle(rows: Iterable[tuple], table_bytes: int, folder: str, level: int = 0) -> Iterator[tuple]:
    """Verdicts (class, smallest id, its row, group size, sha256) of one bucket of local classes.

    Rows are (class, hash, content, (id is null, id, row), size). Beyond the last level all rows of
    a bucket share the whole hash; then the table grows, which only different texts can cause.
    """
    table, best, size, members = ContentTable(), [], [], []
    spills: dict[int, object] = {}
    last = FAN_OUT_BITS * (level + 1) > 64
    for row in rows:
        cls, h, content, first, n = row
        if (k := table.find(h, content)) < 0:
            if table.contents and table.bytes + len(content) > table_bytes and not last:
                b = _branch(h, level)
                if b not in spills:
                    spills[b] = tempfile.TemporaryFile(dir=folder)
                pickle.dump(row, spills[b], protocol=5)
                continue
            k = table.add(h, content)
            best.append(first)
            size.append(0)
            members.append(array("q"))
        best[k] = min(best[k], first)
        size[k] += n
        members[k].append(cls)
    for k, content in enumerate(table.contents):
        missing, keep, keep_row = best[k]
        digest = hashlib.sha256(content).hexdigest()
        for cls in members[k]:
            yield cls, None if missing else keep, keep_row, size[k], digest
    del table, best, size, members
    for f in spills.values():
        f.seek(0)
        yield from settle(_read(f), table_bytes, folder, level + 1)
        f.close()


def _read(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _verdicts(table_bytes: int):
    def rows(batches):
        for batch in batches:
            for cls, h, content, missing, doc, row, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield cls, h, content, (missing, doc, row), n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            out: list[tuple] = []
            for verdict in settle(rows(batches), table_bytes, folder):
                out.append(verdict)
                if len(out) >= 10 * OUT_ROWS:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _VERDICTS)], schema=_VERDICTS)

    return run


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None, table_bytes: int = TABLE_BYTES, max_ids: int = MAX_IDS
) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256, row).

    Texts are equal when equal after ``normal_text``; null counts as empty. Exactly one row of each
    group has ``kept``: the smallest id, null ids last, ties (repeated rows) by ``row``. ``row`` is a
    unique number of the input row, by default the position in the scan. ``keep_id`` is null only when
    all ids of the group are. An empty table gives an empty result; other columns are not read.
    """
    base = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        normal_text(F.col(text_col)).alias("t"),
    ).select("doc_id", "row", F.xxhash64("t").alias("h"), F.col("t").cast("binary").alias("content"))
    classes = stored(
        base.mapInArrow(_local_classes(table_bytes, max_ids), "cls bigint, h bigint, content binary, ids array<bigint>, rows array<bigint>"), "exact-classes"
    )
    pairs = F.arrays_zip(F.col("ids").alias("id"), F.col("rows").alias("row"))
    first = F.array_min(F.transform(pairs, lambda p: F.struct(p["id"].isNull().alias("missing"), F.coalesce(p["id"], F.lit(0)).alias("id"), p["row"].alias("row"))))
    verdicts = (
        classes.select("cls", "h", "content", first.alias("f"), F.size("ids").cast("bigint").alias("n"))
        .select("cls", "h", "content", "f.missing", "f.id", "f.row", "n")
        .repartition("h")
        .mapInArrow(_verdicts(table_bytes), "cls bigint, keep_id bigint, keep_row bigint, group_size bigint, text_sha256 string")
    )
    return (
        classes.select("cls", pairs.alias("members"))
        .join(verdicts, "cls")
        .select(F.explode("members").alias("m"), "keep_id", "keep_row", "group_size", "text_sha256")
        .select(
            F.col("m.id").alias("doc_id"), "keep_id", "group_size", (F.col("m.row") == F.col("keep_row")).alias("kept"), "text_sha256", F.col("m.row").alias("row")
        )
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Null, empty and blank texts follow ``normal_text``, null ids come last, of repeated rows the first position stays.
    Texts of any length are compared whole; an empty table gives no rows; other columns pass through under any name.
    """
    row = fresh(docs, "_row")
    numbered = settled(docs).withColumn(row, F.monotonically_increasing_id())
    kept = exact_dedup(numbered, row=F.col(row)).filter("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
