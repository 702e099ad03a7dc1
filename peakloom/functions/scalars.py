"""Scalar helpers used in scores and reports, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def log_sum_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def binomial_cdf(k: Column, n: int, p: float) -> Column:
    """P(X <= k) for a fixed n and p; the terms are constants in log form."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(n + 1)
    ]
    total, steps = 0.0, []
    for v in logs:
        total += math.exp(v)
        steps.append(min(total, 1.0))
    table = F.array(*[F.lit(v) for v in steps])
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(F.get(table, k.cast("int")))


def min_count_for(n: int, p: float, target: float) -> int:
    """Smallest k with P(X <= k) at or above the target."""
    total = 0.0
    for k in range(n + 1):
        total += math.exp(
            math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
        )
        if total >= target:
            return k
    return n


def split_fields(text: Column, delimiter: str) -> Column:
    """Fields of a delimited text without the empty ones."""
    return F.filter(F.split(text, f"\\Q{delimiter}\\E"), lambda x: x != "")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def range_text(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``1-4,7,9-12`` per key: runs of consecutive integers. Rows collapse to runs before a
    key's runs are joined to one text."""
    w = W.partitionBy(*keys).orderBy(value)
    runs = (
        df.select(*keys, value).distinct()
        .withColumn("_g", F.col(value) - F.row_number().over(w))
        .groupBy(*keys, "_g")
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    )
    part = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    items = F.sort_array(F.collect_list(F.struct("lo", part.alias("t"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(items, lambda s: s["t"]), ",").alias("ranges"))
