"""Sessions with the settings that the engine expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(master: str | None = None, name: str = "loomline", **more: str) -> SparkSession:
    """A session; on a cluster leave ``master`` to the launcher."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; where they have it installed this changes nothing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    held = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in held:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in held if p] + [root])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all of Spark is one local process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")
