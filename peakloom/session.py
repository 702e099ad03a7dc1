"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", app: str = "peakloom", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster values win when passed."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let the Python workers of a session import this package by name, wherever the job was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([*filter(None, env.get("PYTHONPATH", "").split(os.pathsep)), root]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where none is set and the session is local."""
    context = spark.sparkContext._jsc.sc()
    active = context.getCheckpointDir()
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if active.isDefined() and (not configured or configured.rstrip("/") in active.get()):
        return active.get()
    local = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
    if not configured and not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="peakloom-"))
    return context.getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
