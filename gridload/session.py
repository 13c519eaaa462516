"""Session helpers: settings the operators rely on, and where to put files."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: folders made by this process, see ``clean_up``
_MADE: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every operator assumes (UTC clock, AQE), and let
    Python workers find this package wherever the driver was started."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    workers = spark.sparkContext.environment
    known = [p for p in workers.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        workers["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a ``local`` master may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="gridload-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def allow_checkpoints(spark: SparkSession) -> None:
    """Let iterative learners cut the lineage of what they keep: a checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table as Parquet under the shared folder and read it back.

    The result is columnar (readers fetch only the columns they need), survives lost
    executors and has no lineage. Row order and partitioning are not kept.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _MADE:
        _MADE.remove(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made and no one reads any more."""
    path = getattr(df, "_written_at", None)
    if path is not None:
        _delete(df.sparkSession, path)


def made() -> int:
    """How many folders this process has made and not deleted, for ``discard_since``."""
    return len(_MADE)


def discard_since(spark: SparkSession, before: int, *keep: DataFrame) -> None:
    """Delete the folders made since ``made()`` was ``before``, but those of ``keep``."""
    kept = {getattr(df, "_written_at", None) for df in keep}
    for path in _MADE[before:]:
        if path not in kept:
            _delete(spark, path)


def durable(df: DataFrame) -> DataFrame:
    """``written``, for intermediate results that several later steps need."""
    return written(df, "durable")


def clean_up(spark: SparkSession) -> None:
    """Delete every folder this process made under the shared folder."""
    for path in list(_MADE):
        _delete(spark, path)
