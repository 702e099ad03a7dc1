"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from peakloom.session import scratch_path

#: ASCII white space, as a character class body for regular expressions.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; pure ASCII strings take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def text_bytes(c: str) -> Column:
    """The UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(F.col(c), F.lit("")).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settled(df: DataFrame) -> DataFrame:
    """A frame whose rows keep their positions each time it is read.

    A plain scan of files does; anything else is stored first, because a shuffle may deal rows otherwise
    when other columns are asked for.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() in ("Project", "Filter"):
        node = node.children().head()
    return df if node.getClass().getSimpleName() == "LogicalRelation" else stored(df, "settled")
