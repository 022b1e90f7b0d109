"""What the operators of this subpackage share: shared-folder tables, batch sizes, byte classes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a token: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
#: Words of letters and digits in any script, before and after lower-casing A-Z.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: One pass of bytes.translate(): A-Z to a-z, every other ASCII byte but digits and a-z to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where none is set, and on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str, mark: int, keep: int = 0) -> DataFrame:
    """materialize(), then delete the tables that were made for df since made() was mark, but the last `keep` of them."""
    out = materialize(df, name)
    end = len(_made) - 1 - keep
    for gone in _made[mark:end]:
        _delete(df.sparkSession, gone)
    del _made[mark:end]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plan_parts(df: DataFrame, each: int) -> int:
    """Partitions of `each` bytes by the optimizer's estimate of df (of files: what they take); without one, the session's number."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 55:  # nothing is known of it
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // each))


def made() -> int:
    return len(_made)


def release(spark: SparkSession) -> None:
    """Delete what materialize() wrote; results that still read it must be done."""
    while _made:
        _delete(spark, _made.pop())


#: Rows of keys up to which a side of a join is broadcast (under 64 MB).
BROADCAST_ROWS = 1 << 20


def checked_broadcast(df: DataFrame) -> DataFrame:
    """df, which is stored and narrow, marked to be broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with an identity for each row, and that column's name: two scans of it can't tell rows apart differently.

    Rows of files are known by file and place in it, however a scan is split. Any other df is written with numbers.
    """
    row = spare(df, "_row")
    try:
        known = df.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))
        return known.select(*[F.col(f"`{c}`") for c in df.columns], row), row
    except AnalysisException:
        return materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    return F.translate(col, UPPER, UPPER.lower())
