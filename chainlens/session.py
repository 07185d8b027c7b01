"""Session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "8", memory: str = "12g") -> SparkSession:
    """Session for tests and local runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chainlens")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_local_folder: list[str] = []
_written: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder that the cluster names; a temporary one only for local runs without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="run-"))
    return _local_folder[0]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written once to the shared folder and read back.

    For results that several later steps read: they are computed once, survive
    the loss of executors, and have sizes the planner knows.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget_stored(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` wrote in this process, once no result reads them; their number."""
    for path in _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    n = len(_written)
    _written.clear()
    return n
