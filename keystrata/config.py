"""Settings, read from the session's configuration, with their defaults."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "scanPruning": "true",  # skip files by their key ranges
    "vacuumRebuild": "true",  # vacuum() recomputes key ranges that aren't valid
    "retainSeconds": "604800",  # vacuum() keeps what versions name that were the latest within so many seconds
    "lazyUpdate": "false",  # update() gives up the key ranges instead of keeping them
    "annTiming": "false",  # searches print how long their stages took
    "levelCache": "4",  # so many graphs' levels stay with the tasks between searches; 0: none
    "graphPatience": "0",  # expansions without improvement after which a graph search stops; 0: none
    "broadcastBytes": str(256 << 20),  # most bytes of a model or graph that every task holds
}


def setting(spark: SparkSession, name: str) -> str:
    return spark.conf.get(f"spark.keystrata.{name}", DEFAULTS[name])


def flag(spark: SparkSession, name: str) -> bool:
    return setting(spark, name).lower() == "true"


def shared_folder(spark: SparkSession) -> str:
    """Where tables of intermediate results go: spark.checkpoint.dir; a local folder only where that is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="keystrata-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named
