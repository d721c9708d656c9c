"""Incremental scans: files and events that arrive are taken once, in batches whose commits can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_new(spark: SparkSession, folder: str, schema: StructType, checkpoint: str, handle: Callable[[DataFrame, int], None], per_batch: int = 200) -> None:
    """Give the rows of files not seen before to handle(rows, batch), some files at a time, until none is left. A batch
    that failed comes again under its number, so handle must not count one twice (see `append_once`)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own: the same batch written again replaces itself."""

    def handle(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return handle


def remaining(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items of batches that are not completed: what a resumed scan still reads."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def progress(items: DataFrame, key: str) -> DataFrame:
    """Per session how many items there are, are done and have failed, and the faces found."""
    count = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return items.groupBy(key).agg(F.count("*").alias("n_items"), count("succeeded").alias("n_done"), count("failed").alias("n_failed"), F.coalesce(F.sum("face_count"), F.lit(0)).alias("n_faces"))


def progress_once(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A handler that keeps what a batch adds to the progress of its sessions, under the batch's number."""

    def handle(rows: DataFrame, batch: int) -> None:
        progress(rows, key).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return handle


def total_progress(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The progress of all sessions over the batches so far: rows for each session and batch, not for each item."""
    counts = ("n_items", "n_done", "n_failed", "n_faces")
    return spark.read.parquet(path).groupBy(key).agg(*(F.sum(c).cast("long").alias(c) for c in counts))


def resumed(start: Callable[[], None], tries: int = 3) -> int:
    """Run a scan until it ends without a failure, and say how many runs that took; the last failure is raised."""
    for n in range(1, tries + 1):
        try:
            start()
            return n
        except Exception:
            if n == tries:
                raise
    return 0


def append_log(events: DataFrame, path: str) -> None:
    """Events as JSON lines, one file for each task, beside those there are."""
    events.write.mode("append").json(path)
