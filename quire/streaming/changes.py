"""Incremental maintenance: what changed, idempotent upserts of derived tables, failure memory, a file-source stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators.fulltext import build_index


def diff(desired: DataFrame, have: DataFrame, key: str = "rid", stamp: str = "text_hash") -> DataFrame:
    """key, change: added, changed or removed. Only keys and stamps are compared, never texts."""
    a = desired.select(key, F.col(stamp).alias("_new"), F.lit(True).alias("_d"))
    b = have.select(key, F.col(stamp).alias("_old"), F.lit(True).alias("_h"))
    change = F.when(F.col("_h").isNull(), "added").when(F.col("_d").isNull(), "removed").when(~F.col("_new").eqNullSafe(F.col("_old")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def local_rid(book: Column, rank: Column) -> Column:
    """Ids of locally extracted texts: negative, so that they never meet those of the library."""
    return -(book * 64 + rank)


def backfill(state: DataFrame, derived: DataFrame, key: str = "rid") -> DataFrame:
    """Rows of the state that a later index lacks."""
    return state.join(derived.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """old without the keys of new and gone, plus new: applying the same batch again changes nothing."""
    touched = new.select(key).union(gone.select(key)).distinct()
    return old.join(touched, key, "left_anti").unionByName(new)


class VersionedTable:
    """A table kept as numbered Parquet folders; a version counts once its marker exists, so a lost writer leaves no trace."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        if not self._fs.exists(self._path("")):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        done = [int(n[1:]) for n in names if n[1:].isdigit() and self._fs.exists(self._path(f"{n}/_SUCCESS"))]
        return max(done, default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}") if v >= 0 else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, keep: int = 2) -> None:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        for old in range(max(0, v - keep - 3), v - keep + 1):
            self._fs.delete(self._path(f"v{old}"), True)


STATE = "rid long, book long, fmt string, text_hash string"
POSTINGS = "rid long, term string, positions array<int>"
ROWS = "rid long, book long, fmt string, dl long"


def sync_index(spark: SparkSession, texts: DataFrame, path: str, complete: bool = True, stem: bool = False) -> dict[str, int]:
    """Bring the index under path up to texts (rid, book, fmt, text). complete: rows missing from texts are removed."""
    state, postings, rows = (VersionedTable(spark, f"{path}/{n}", s) for n, s in (("state", STATE), ("postings", POSTINGS), ("rows", ROWS)))
    wanted = texts.withColumn("text_hash", F.md5(F.coalesce("text", F.lit(""))))
    have = state.read()
    changes = diff(wanted, have if complete else have.join(wanted.select("rid"), "rid", "left_semi")).cache()
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    if counts:
        new = wanted.join(changes.where("change != 'removed'"), "rid", "left_semi")
        gone = changes.where("change = 'removed'")
        index = build_index(new, stem)
        postings.write(upsert(postings.read(), index.postings, changes, "rid"))
        rows.write(upsert(rows.read(), index.rows, changes, "rid"))
        state.write(upsert(have, new.select("rid", "book", "fmt", "text_hash"), gone, "rid"))  # last: until then a rerun repeats the batch
    changes.unpersist()
    return {k: counts.get(k, 0) for k in ("added", "changed", "removed")}


def stream_index(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, every: str | None = None):
    """Follow a folder of Parquet texts (rid, book, fmt, text); each micro-batch is one sync. every: None runs what is there."""
    stream = spark.readStream.schema(schema).parquet(source)
    # of several versions in one batch the newest file's, then the greatest text
    stream = stream.withColumn("_time", F.col("_metadata.file_modification_time"))
    latest = [F.desc("_time"), F.desc("text")]

    def batch(df: DataFrame, _: int) -> None:
        sync_index(df.sparkSession, df.withColumn("_n", F.row_number().over(W.partitionBy("rid").orderBy(*latest))).where("_n = 1").drop("_n", "_time"), path, complete=False)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_extract(files: DataFrame, done: DataFrame, failures: DataFrame, retry_failed: bool = False, force: bool = False) -> DataFrame:
    """files: book, stamp. Those without a text and without a failure at the same stamp."""
    out = files if force else files.join(done.select("book"), "book", "left_anti")
    return out if force or retry_failed else out.join(failures.select("book", "stamp"), ["book", "stamp"], "left_anti")


def book_stamp(files: DataFrame) -> DataFrame:
    """files: book, fmt, mtime, size. One stamp for each book from all its files."""
    one = F.concat_ws(":", "fmt", F.col("mtime").cast("long").cast("string"), F.col("size").cast("string"))
    return files.groupBy("book").agg(F.array_join(F.sort_array(F.collect_list(one)), "|").alias("stamp"))


def remember_failures(old: DataFrame, new: DataFrame, cleared: DataFrame) -> DataFrame:
    """Failures by book: the new ones replace the old, those of cleared books go."""
    return upsert(old, new, cleared, "book")

