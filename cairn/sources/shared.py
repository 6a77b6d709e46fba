"""Tables written to the folder that a cluster's machines share, for results that are read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a session in one process, and an error on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/cairn-{uuid.uuid4().hex}/{name}"


def parts(df: DataFrame, rows: int = 100_000) -> int:
    """Into how many partitions df is dealt so that each has about so many rows, at least as many as there are cores.

    A step that makes several rows of each keeps a task's memory so, however
    large the table is. df should be a table as it was read, whose files know their rows.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


#: Joins by document and more take tables that are dealt by document alone as they lie.
WITHIN = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def written(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """df as a table of its own: what reads it, how often it may, does not compute it again, and a lost executor costs no more than its tasks.

    settings hold for the session while it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
