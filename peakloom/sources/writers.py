"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from peakloom.functions.ordered import range_numbers
from peakloom.operators.keyed import mz_bucket

MASS_DA = lambda c: F.format_string("%.4f", c / 10_000)


def _write_blocks(lines: DataFrame, key: str, path: str) -> None:
    """Write lines grouped by key and ordered inside it.

    Rows stay rows: a block is a sorted stretch of one partition, so no block is ever held
    in memory. ``lines``: key, part, at, value.
    """
    lines.repartition(key).sortWithinPartitions(key, "part", "at").select("value").write.text(path)


def write_mgf(spectra: DataFrame, peaks: DataFrame, path: str) -> None:
    """Block text. ``spectra``: spectrum_id, title, scan, charge, mz_u and maybe peptide."""
    head = [
        F.lit("BEGIN IONS"),
        F.concat(F.lit("TITLE="), F.col("title")),
        F.concat(F.lit("SCANS="), F.col("scan").cast("string")),
        F.concat(F.lit("CHARGE="), F.col("charge").cast("string"), F.lit("+")),
        F.concat(F.lit("PEPMASS="), MASS_DA(F.col("mz_u"))),
    ]
    if "peptide" in spectra.columns:
        head.insert(2, F.concat(F.lit("SEQ="), F.col("peptide")))
    zero = F.lit(0).cast("bigint").alias("at")
    first = spectra.select("spectrum_id", F.lit(0).alias("part"), zero, F.concat_ws("\n", *head).alias("value"))
    last = spectra.select("spectrum_id", F.lit(2).alias("part"), zero, F.lit("END IONS\n").alias("value"))
    value = F.concat(MASS_DA(F.col("mass_u")), F.lit(" "), F.format_string("%.3f", F.col("intensity").cast("double")))
    body = peaks.join(spectra.select("spectrum_id"), "spectrum_id", "left_semi").select(
        "spectrum_id", F.lit(1).alias("part"), F.col("mass_u").alias("at"), value.alias("value")
    )
    _write_blocks(first.unionByName(body).unionByName(last), "spectrum_id", path)


def write_mz_buckets(spectra: DataFrame, path: str, width: int, max_mz: int, min_peaks: int = 5, rows_per_task: int = 1_000_000) -> None:
    """Partition folders by m/z bucket; spectra out of range or with few peaks are skipped.

    Rows are first brought together by bucket and a salt that grows with the rows of the bucket, so that
    each folder gets a few large files and a crowded bucket is still written by many tasks.
    """
    kept = spectra.filter((F.col("mz_u") > 0) & (F.col("n_peaks") >= min_peaks))
    laid = kept.withColumn("bucket", mz_bucket(F.col("mz_u"), width, max_mz))
    # at most max_mz / width + 1 rows
    shares = F.broadcast(laid.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / rows_per_task).alias("_tasks")))
    salted = laid.join(shares, "bucket").repartition("bucket", F.pmod(F.xxhash64("spectrum_id"), F.col("_tasks"))).select(*laid.columns)
    salted.write.partitionBy("bucket").parquet(path)


def write_sharded(df: DataFrame, path: str, max_rows: int) -> DataFrame:
    """Roll output files after ``max_rows`` rows and return the list of files with their rows."""
    df.write.option("maxRecordsPerFile", max_rows).parquet(path)
    written = df.sparkSession.read.parquet(path)
    return written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def fasta_records(seqs: DataFrame, col: str, per_record: int) -> DataFrame:
    """Join ``per_record`` sequences, in order, into one record ``TRUE_<n>``."""
    ordered = range_numbers(seqs.select(col), [], [F.col(col)], "rn")
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", col))), lambda s: s[col]), ""
    )
    return (
        ordered.groupBy(F.floor((F.col("rn") - 1) / per_record).alias("n"))
        .agg(joined.alias("seq"))
        .select(F.concat(F.lit("TRUE_"), F.col("n").cast("string")).alias("record"), "seq")
    )


def write_fasta(records: DataFrame, path: str, name: str, seq: str) -> None:
    records.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def mz_list(spectra: DataFrame) -> DataFrame:
    return spectra.select("file_idx", "scan", F.round(F.col("mz_u") / 10_000, 4).alias("mz"))
