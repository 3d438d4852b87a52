"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the checkpoint folder that the session has set.

    Where neither is set, a session whose tasks run in its own process has a
    temporary one; on a cluster that is an error, as executors wouldn't see each other's files.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = context._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="strandlink-")
        context.setCheckpointDir(where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: its plan is run once, whatever is built on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlink-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_state(spark: SparkSession, folder: str, number: int, state: dict[str, Any]) -> None:
    """Keeps the last two numbered states of a loop in ``folder``, so that one is whole whenever the driver is lost."""
    to = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state-{number % 2}.json")
    stream = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    try:
        stream.write(bytearray(json.dumps({"number": number, "state": state}).encode()))
    finally:
        stream.close()


def last_state(spark: SparkSession, folder: str) -> tuple[int, dict[str, Any]] | None:
    """The number and the state saved last in ``folder``; a file that was cut short doesn't count."""
    found = []
    for k in (0, 1):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state-{k}.json")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            stream = files.open(path)
            try:
                value = json.loads(bytes(stream.readAllBytes()).decode(errors="replace"))
            except ValueError:
                continue
            except Py4JJavaError as e:
                if "ChecksumException" not in e.java_exception.getClass().getName():
                    raise
                continue
            finally:
                stream.close()
            found.append((value["number"], value["state"]))
    return max(found, key=lambda x: x[0], default=None)
