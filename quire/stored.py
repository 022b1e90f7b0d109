"""Tables that are built once in a session and read by many queries, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_paths: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the session's checkpoint folder; on one machine, where neither is set, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time by bytes too: pages may be long, and 10,000 rows of them much."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def state_of(df: DataFrame) -> tuple:
    """What tells whether df's files have changed: paths, sizes, times."""
    spark = df.sparkSession
    out = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def build_once(spark: SparkSession, kind: str, source: DataFrame, build: Callable[[str], None]) -> str:
    """The path under which build(path) has put what is made of source's files as they are now."""
    key = (spark.sparkContext.applicationId, kind, state_of(source))
    if key not in _paths:
        path = f"{folder(spark)}/quire/{kind}-{uuid.uuid4().hex}"
        build(path)
        _paths[key] = path
    return _paths[key]
