"""State carried between runs, as streaming jobs over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

SCAN_KEY = ["generation", "file_idx", "scan"]


def stream_new_scans(scans: DataFrame, delay: str) -> DataFrame:
    """Scans not seen before, by (generation, file, scan), within the watermark delay."""
    return scans.withWatermark("ts", delay).dropDuplicatesWithinWatermark(SCAN_KEY)


def stream_peptide_history(uses: DataFrame) -> DataFrame:
    """Running number of uses per peptide."""
    return uses.groupBy("peptide").agg(F.count(F.lit(1)).alias("uses"))


def run_append(stream: DataFrame, spark: SparkSession, out: str, state: str) -> DataFrame:
    """Process what is available now into the table ``out`` and return all that it holds.

    ``state`` is the folder of the job's state; with the same two folders a later run goes on where
    the last one ended.
    """
    job = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _ids(spark: SparkSession, out: str, kind: str) -> list[int]:
    """Numbers of the complete folders ``<kind>=<number>`` below ``out``."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(path(f"{out}/{n}/_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def newer_folders(spark: SparkSession, out: str) -> tuple[list[str], int]:
    """The newest snapshot and the batches after it, and the number of the last of them (-1 without any)."""
    snapshot = max(_ids(spark, out, "snapshot"), default=-1)
    batches = [b for b in _ids(spark, out, "batch") if b > snapshot]
    return [f"{out}/snapshot={snapshot}"] * (snapshot >= 0) + [f"{out}/batch={b}" for b in batches], max([snapshot, *batches])


def latest_rows(spark: SparkSession, out: str, schema: StructType, keys: list[str], newest: str) -> DataFrame:
    """The latest row of each key: from one snapshot and the few batches since."""
    folders, _ = newer_folders(spark, out)
    if not folders:
        return spark.createDataFrame([], schema).select(*keys, newest)
    return spark.read.schema(schema).parquet(*folders).groupBy(*keys).agg(F.max(newest).alias(newest))


def compact(spark: SparkSession, out: str, schema: StructType, keys: list[str], newest: str) -> None:
    """Write the latest rows as a snapshot and remove what it replaces.

    A snapshot counts once it is complete, so a run that is cut off leaves the old one and its batches,
    and the next run removes what was left over.
    """
    folders, last = newer_folders(spark, out)
    if len(folders) > 1 or (folders and "/batch=" in folders[0]):
        latest_rows(spark, out, schema, keys, newest).write.mode("overwrite").parquet(f"{out}/snapshot={last}")
    for kind in ("snapshot", "batch"):
        for number in _ids(spark, out, kind):
            if number < last or (kind == "batch" and number == last):
                _drop(spark, f"{out}/{kind}={number}")


def run_update(stream: DataFrame, spark: SparkSession, out: str, state: str, keys: list[str], newest: str) -> DataFrame:
    """Process what is available now in update mode; the latest row per key is the final state.

    Each batch writes its changed rows to a folder of its own, so a repeated batch overwrites itself and
    nothing passes through the driver. After the run the batches become one snapshot with a row a key,
    so a read costs as much after many runs as after one. Folders as in ``run_append``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    job = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start()
    job.awaitTermination()
    compact(spark, out, stream.schema, keys, newest)
    return latest_rows(spark, out, stream.schema, keys, newest)
