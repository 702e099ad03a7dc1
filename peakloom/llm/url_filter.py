"""URL filter rules as a sort-merge range join.

A host is keyed by its labels in reverse, each followed by a dot: the rule host ``example.com`` has
the key ``com.example.`` and covers the interval of all keys that begin with it. Urls and rules are
sorted together by key (a rule before its urls). A sweep keeps the stack of rules whose interval is
still open; the rules that a url lies in are those on the stack, and paths decide among them.

The sort is a range partitioning over (key, kind, path, page), so one host may fill many
partitions. Rules that are open where a partition begins are found by the prefixes of its first key
(one key per partition) and put in front of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from peakloom.llm.common import UPPER, stored

RULE, URL = 0, 1
DEFAULT_VERDICT = "allow"

_OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def url_host(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, rule_host, rule_path, verdict) from pairs of a verdict and a rule such as ``example.com/en/``."""
    df = spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")
    cut = F.locate("/", "rule")
    return df.select(
        "rule",
        F.when(cut > 0, F.expr("substring(rule, 1, locate('/', rule) - 1)")).otherwise(F.col("rule")).alias("rule_host"),
        F.when(cut > 0, F.expr("substring(rule, locate('/', rule))")).otherwise(F.lit("")).alias("rule_path"),
        "verdict",
    )


class OpenRules:
    """The stack of nested host intervals that are open at the sweep's key, each with its path rules."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def move_to(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.move_to(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        # equal host and path twice: the smaller (verdict, rule) counts, whatever the order
        paths[path] = min(paths.get(path, (verdict, rule)), (verdict, rule))
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest fitting rule; the longer host wins a tie."""
        best, size = None, -1
        for key, paths, lengths in reversed(self.stack):
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])) is not None:
                    if len(key) + n > size:
                        best, size = hit, len(key) + n
                    break
        return best


def _sweep(default: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rules = None, OpenRules()
        for batch in batches:
            out: list[tuple] = []
            for p, key, kind, path, page, host, rule, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, rules = p, OpenRules()
                if kind == RULE:
                    rules.open(key, path, rule, verdict)
                    continue
                rules.move_to(key)
                hit = rules.longest(path)
                out.append((page, host, path, hit[1] if hit else None, hit[0] if hit else default))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return run


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` has (rule, rule_host, rule_path, verdict). A rule fits its host and all subdomains when
    the path begins with its path; the longest (host plus path) wins. Without a rule, ``rule`` is null
    and the verdict is ``default``. A null url, or one without ``://``, has an empty host and path.
    Null ids and repeated rows pass through; no rules or no pages are fine; other columns are not read.
    """
    urls = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = urls.select(host_key(F.col("host")).alias("key"), F.lit(URL).alias("kind"), "path", "page_id", "host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    marks = rules.filter(F.col("rule_host").isNotNull()).select(
        host_key(F.col("rule_host")).alias("key"), F.lit(RULE).alias("kind"), F.coalesce("rule_path", F.lit("")).alias("path"),
        F.lit(None).cast("bigint").alias("page_id"), F.col("rule_host").alias("host"), "rule", "verdict",
    )
    order = ["key", "kind", "path", "page_id"]
    ranged = stored(urls.unionByName(marks).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "url-ranges")
    begins = ranged.groupBy("part").agg(F.min(F.struct(*order)).alias("b"))
    # every rule whose interval holds a first key and that sorts before it, from an earlier partition
    labels = F.split(F.rtrim(F.col("b.key"), F.lit(".")), r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    opened = begins.select(F.col("part").alias("at"), F.explode(F.array_distinct(F.concat(prefixes, F.array("b.key")))).alias("key"))
    earlier = ranged.filter(F.col("kind") == RULE).join(opened, "key").filter("part < at")
    carried = earlier.select(*[c for c in ranged.columns if c != "part"], F.col("at").alias("part"))
    rows = ranged.unionByName(carried).repartition("part").sortWithinPartitions("part", *order)
    rows = rows.select("part", "key", "kind", "path", "page_id", "host", "rule", "verdict")
    return rows.mapInArrow(_sweep(default), "page_id bigint, host string, path string, rule string, verdict string")
