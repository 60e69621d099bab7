"""The folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a temporary one on a single machine, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weirflow-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def new_folder(spark: SparkSession, what: str) -> str:
    """The path of a folder in it that isn't there yet."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written_lines(spark: SparkSession, what: str, lines: list[str]) -> str:
    """The path of a new text file with these lines, for a few."""
    path = new_folder(spark, what)
    rows: DataFrame = spark.createDataFrame([("\n".join(lines),)], "value string")
    rows.coalesce(1).write.text(path)
    return path
