"""Mixing sources to target weights by hash thresholds, with DataFrame functions only.

Every row has a place on its source's axis: a 60-bit hash of its content, then a hash of its row for
rows with equal contents. A mix takes ``full`` whole copies of a source and one more copy of the rows
below a threshold on the axis, so a smaller budget is always contained in a larger one. Thresholds come
from histograms: tokens are summed by (source, 12 hash bits), running sums over at most 4,096 buckets
give the bucket in which the budget ends, and only the rows of that bucket are refined by the next
bits. Equal contents are summed to one row before the last step, so that a source that is one text
over and over costs no more. The documents are then filtered by their source's threshold, unsorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.functions.ordered import running_sums
from peakloom.llm.common import SPACE, fresh, settled, stored
from peakloom.llm.sharding import row_numbers

WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
KEY_BITS, STEP_BITS = 60, 12
#: Rows of one source that a window may sort; more are refined by another histogram.
LAST_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def _bits(text: Column) -> Column:
    """60 bits of a text's md5 sum."""
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def source_key(source: Column) -> Column:
    """A key without nulls: the null source is the empty text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def places(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> dict[str, Column]:
    """The key of a row's source and the row's place on its axis."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "src": source_key(F.col(source_col).cast("string")),
        "key": _bits(F.concat_ws(":", name, text).cast("binary")),
        "row_key": _bits(F.monotonically_increasing_id().cast("string").cast("binary")),
    }


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, src, size, key, row_key): one small row per document; ``docs`` must be settled."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        *[c.alias(name) for name, c in places(id_col, text_col, source_col).items()],
    )


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, shares: Sequence[float] = (1.0,), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(src, source_size, share, target) from one row per source (source, src, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn (positive whole numbers). Share i
    of all words is dealt by weight; no source takes more than ``max_repeats`` times its words, and the
    excess goes to the others by weight. A source is capped where the level at which it fills up needs
    no more words than there are; running sums in the order of these levels tell all of them at once.
    """
    numbered, _ = row_numbers(sources.withColumn("no_name", F.col("source").isNull()), ["no_name", "source"])
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = stored(numbered.select("src", "source_size", "number", weight.alias("w"), (F.col("source_size") * max_repeats).alias("cap")), "mix-sources")
    words, w_all = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    budgets = F.array(*[F.struct(F.lit(i).alias("share"), F.lit(round(words * s)).cast("bigint").alias("budget")) for i, s in enumerate(shares)])
    dealt = weighed.select("*", F.explode(budgets).alias("b")).select("src", "source_size", "number", "w", "cap", "b.*")
    level = F.col("cap") / F.col("w")
    summed = running_sums(dealt, ["share"], F.floor(F.log2(level + 1) * 64), [level, F.col("number")], {"cap_upto": F.col("cap"), "w_upto": F.col("w")})
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    needs = exact("cap_upto") * exact("w") + exact("cap") * (F.lit(w_all).cast("decimal(38,0)") - exact("w_upto"))
    capped = stored(summed.withColumn("capped", needs <= exact("budget") * exact("w")), "mix-capped")
    free = capped.groupBy("share").agg(
        (F.first("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0))).alias("left"), F.sum(F.when(~F.col("capped"), F.col("w"))).alias("w_left")
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("left")).cast("double") / F.col("w_left"))
    # one row per share
    return capped.join(F.broadcast(free), "share").select("src", "source_size", "share", target.alias("target"))


def _largest(rows: DataFrame) -> int:
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _ends(sums: DataFrame, limits: DataFrame, order: str, prefix: Column) -> DataFrame:
    """(src, share, <order>, rest): where the running sum of ``n`` passes each limit, and what is left there."""
    near = sums.withColumn("prefix", prefix).join(limits, ["src", "prefix"])
    upto = F.sum("n").over(W.partitionBy("src", "share").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    ended = near.withColumn("upto", upto).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
    return ended.select("src", "share", order, (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))


def boundary_keys(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """(src, share, key, rest): the key at which the sizes of a source, in order of keys, pass its limit.

    ``rows`` has (src, key, size), ``limits`` (src, share, rest). All rows are read once for the first
    histogram, then only those of a bucket in which a limit falls.
    """
    found, shift = limits.select("src", "share", "rest", F.lit(0).cast("bigint").alias("prefix")), KEY_BITS
    while shift and _largest(rows) > LAST_ROWS:
        shift -= STEP_BITS
        sums = rows.groupBy("src", F.shiftright("key", shift).alias("part")).agg(F.sum("size").alias("n"))
        found = stored(_ends(sums, found, "part", F.shiftright("part", STEP_BITS)).withColumnRenamed("part", "prefix"), "mix-buckets")
        held = found.select("src", "prefix").distinct()
        rows = stored(rows.withColumn("prefix", F.shiftright("key", shift)).join(held, ["src", "prefix"], "left_semi").drop("prefix"), "mix-boundary")
    sums = rows.groupBy("src", "key").agg(F.sum("size").alias("n"))
    return stored(_ends(sums, found, "key", F.shiftright("key", shift)), "mix-keys")


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, source_size, mix): per source the shares in order, each (share, target, full, key, row_key, last).

    ``last`` tells whether the row at the threshold is taken too: where that comes nearer to the target.
    """
    budget = F.round("target").cast("bigint")
    full = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    limits = targets.withColumn("budget", budget).withColumn("full", full)
    limits = stored(limits.withColumn("rest", F.col("budget") - F.col("full") * F.col("source_size")), "mix-limits")
    keys = boundary_keys(rows.select("src", "key", "size"), limits)
    # rows that share the content of the boundary are told apart by their row keys
    tied = stored(rows.join(keys.select("src", "key").distinct(), ["src", "key"], "left_semi").select("src", "key", "row_key", "size"), "mix-tied")
    pair = F.concat_ws("/", F.col("key").cast("string"), F.col("src"))
    ends = boundary_keys(tied.select(pair.alias("src"), F.col("row_key").alias("key"), "size"), keys.select(pair.alias("src"), "share", "rest"))
    ends = ends.select(F.col("src").alias("pair"), "share", F.col("key").alias("row_key"), F.col("rest").alias("over"))
    at = tied.groupBy(pair.alias("pair"), "row_key").agg(F.max("size").alias("at_size"))
    cut = keys.drop("rest").withColumn("pair", pair).join(ends, ["pair", "share"]).join(at, ["pair", "row_key"])
    cut = cut.select("src", "share", "key", "row_key", (F.col("over") * 2 > F.col("at_size")).alias("last"))
    whole = limits.join(cut, ["src", "share"], "left")
    mix = F.sort_array(F.collect_list(F.struct("share", "target", "full", "key", "row_key", "last")))
    return stored(whole.groupBy("src", "source_size").agg(mix.alias("mix")), "mix-thresholds")


def copies(at: Column, key: Column, row_key: Column) -> Column:
    """How many copies of the row at a place a threshold takes."""
    below = (key < at["key"]) | ((key == at["key"]) & ((row_key < at["row_key"]) | ((row_key == at["row_key"]) & at["last"])))
    return (at["full"] + F.when(below, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def _limits(rows: DataFrame, weights: Sequence[int], shares: Sequence[float], max_repeats: int) -> DataFrame:
    if any(w <= 0 or w != int(w) for w in weights) or not all(0 <= s <= max_repeats for s in shares) or list(shares) != sorted(shares):
        raise ValueError("weights are positive whole numbers, shares rise from 0 to max_repeats")
    sources = rows.groupBy("source", "src").agg(F.sum("size").alias("source_size"))
    return thresholds(rows, source_targets(sources, weights, shares, max_repeats))


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, shares: Sequence[float] = (1.0,), max_repeats: int = MAX_REPEATS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, mixes) of every row; ``mixes`` has (target, copies, taken) per share.

    ``shares`` are budgets as parts of all words, rising; mixes are nested. Whole documents are taken, at
    most ``max_repeats`` times, so a source ends within half of its boundary document from its target. A
    null text has no words and takes none; the null source is a source of its own; null and repeated ids
    are fine. Of rows equal in id, text and source it does not matter which are taken, only how many. An
    empty table gives no rows, and other columns are not read.
    """
    rows = stored(sized_rows(settled(docs), id_col, text_col, source_col), "mix-rows")
    joined = rows.join(_limits(rows, weights, shares, max_repeats), "src")
    times = lambda m: copies(m, F.col("key"), F.col("row_key"))
    mixes = F.transform("mix", lambda m: F.struct(m["target"].alias("target"), times(m).alias("copies"), (F.col("size") * times(m)).alias("taken")))
    return joined.select("doc_id", "source", "size", "source_size", mixes.alias("mixes"))


def mixed_rows(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken."""
    docs, columns = settled(docs), (id_col, text_col, source_col)
    limits = _limits(stored(sized_rows(docs, *columns), "mix-rows"), weights, (share,), max_repeats)
    here, at = fresh(docs, "_place"), fresh(docs, "_limit")
    placed = docs.withColumn(here, F.struct(*[c.alias(name) for name, c in places(*columns).items()]))
    limits = limits.select(F.struct("src", F.col("mix")[0].alias("mix")).alias(at))
    joined = placed.join(limits, F.col(here)["src"] == F.col(at)["src"])
    times = copies(F.col(at)["mix"], F.col(here)["key"], F.col(here)["row_key"])
    repeated = joined.withColumn(here, F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
