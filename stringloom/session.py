"""Session defaults and the shared-storage helpers that every operator uses."""

from __future__ import annotations

import os
import re
import tempfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = (1 << 63) - 1  # no table is larger; also what Spark takes for a size that it doesn't know


def get_session(app: str = "stringloom", cores: int | str = "*") -> SparkSession:
    """A local session with the settings that tests and the benchmark share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STRINGLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is set a local session, as in tests, takes a temporary
    one; on a cluster that is an error, as other machines would not see the folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="stringloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df``; beyond what Python reads as a number, one more than MOST_BYTES."""
    try:
        return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except ValueError:
        return MOST_BYTES + 1


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that its lineage ends there.

    A checkpoint keeps the planner's estimate of its size, and a join multiplies those of its sides: where rounds join what
    earlier rounds cut, the digits double with each until they fill the driver. An estimate over MOST_BYTES is dropped.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    if estimated_bytes(out) <= MOST_BYTES:
        return out
    rows = out._jdf.queryExecution().logical().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), spark)


def drop_folder(path: str) -> None:
    """Remove a folder of the shared one that nothing reads any more."""
    files, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":" in path else (fs.LocalFileSystem(), path)
    files.delete_dir(root)
