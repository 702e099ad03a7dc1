"""Line deduplication across documents, with DataFrame functions only.

Each line of at least ``MIN_KEY`` code points becomes (128-bit hash, document, position). The hashes
are range-partitioned with a secondary sort by document and position, and the first document of a
hash streams down its run; a line is dropped when that document is not its own. Frequent hashes
(found in a sample, which only decides the layout) are spread over sub-buckets and their few local
firsts are combined. What comes back per document is a sparse bitmap of dropped lines: words of 63
bits, absent where all lines stay; documents are only joined with these bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.llm.common import SPACE_CHARS, ascii_lower, fresh, settled, stored

MIN_KEY = 10
WORD = 63
SUB_BUCKETS = 64
SAMPLE_ROWS = 1_000_000
#: A hash is spread when it has more than this share of the sample, so there are at most 2,000.
HEAVY_SHARE = 0.0005


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def line_hashes(docs: DataFrame, row: str, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """(h1, h2, doc, row, pos) of every line whose key is long enough.

    ``doc`` orders the documents: (id is null, id), and the row only where the id is null.
    """
    lines = docs.select(F.col(row).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("row", "id", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_key)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "id", "row", "pos")


def _heavy(lines: DataFrame) -> DataFrame:
    """Hashes that hold more than ``HEAVY_SHARE`` of a sample; bounded by 1 / HEAVY_SHARE rows."""
    n = lines.count()
    sample = lines.select("h1", "h2").sample(min(1.0, SAMPLE_ROWS / max(n, 1)), seed=7)
    least = max(100, int(min(n, SAMPLE_ROWS) * HEAVY_SHARE))
    found = sample.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select("h1", "h2")
    return found.withColumn("heavy", F.lit(True))


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(row, pos) of every line that an earlier document has."""
    lines = lines.withColumn("doc", F.struct(F.col("id").isNull().alias("n"), F.coalesce("id", "row").alias("v")))
    heavy = F.broadcast(stored(_heavy(lines), "heavy-lines"))
    sub = F.when(F.col("heavy"), F.pmod(F.xxhash64("doc"), F.lit(SUB_BUCKETS))).otherwise(F.lit(0)).cast("int")
    dealt = lines.join(heavy, ["h1", "h2"], "left").select("h1", "h2", sub.alias("sub"), F.col("heavy").isNotNull().alias("heavy"), "doc", "row", "pos")
    run = W.partitionBy("h1", "h2", "sub").orderBy("doc", "pos").rowsBetween(W.unboundedPreceding, 0)
    streamed = dealt.repartitionByRange("h1", "h2", "sub").withColumn("first", F.first("doc").over(run))
    # the first row of each (frequent hash, sub-bucket): at most SUB_BUCKETS / HEAVY_SHARE rows
    starts = dealt.filter("heavy").groupBy("h1", "h2").agg(F.min("doc").alias("lowest"))
    joined = streamed.join(F.broadcast(starts), ["h1", "h2"], "left")
    return joined.filter(F.coalesce("lowest", "first") < F.col("doc")).select("row", "pos")


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(row, dropped): a sparse bitmap map<word, bits> per document; absent words keep all lines."""
    words = dropped.select("row", F.expr(f"pos div {WORD}").cast("int").alias("word"), F.expr(f"shiftleft(1L, pos % {WORD})").alias("bit"))
    words = words.repartition("row").groupBy("row", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def is_dropped(bitmap: Column, pos: Column) -> Column:
    word = F.try_element_at(bitmap, F.floor(pos / WORD).cast("int"))
    return F.coalesce(F.getbit(word, (pos % WORD).cast("int")) == 1, F.lit(False))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped, kept_text) of every row.

    A null or empty text is one empty line. Keys shorter than ``min_key`` code points always stay, and
    so do repeats inside the first document. Rows with equal ids are one document; rows with a null id
    come after all others, each a document of its own. ``dropped`` is null where nothing goes. An empty
    table gives no rows; other columns are not read.
    """
    row = fresh(docs, "_row")
    base = settled(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias(row))
    lines = stored(line_hashes(base, row, "doc_id", "text", min_key), "lines")
    maps = drop_bitmaps(dropped_lines(lines)).withColumnRenamed("row", row)
    joined = base.join(maps, row, "left")
    bits = F.aggregate(F.map_values("dropped"), F.lit(0), lambda n, w: n + F.bit_count(w))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~is_dropped(F.col("dropped"), i)), "\n")
    return joined.select(
        "doc_id",
        F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce(F.when(F.col("dropped").isNotNull(), bits), F.lit(0)).cast("bigint").alias("n_dropped"),
        "dropped",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
