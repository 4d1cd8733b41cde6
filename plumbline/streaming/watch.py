"""Runs as streams: edit events that are answered as they come, and files that are checked whenever they are written.

A stream's life is that of its query (start, query.stop()); each micro-batch is one batch plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import results, run

Sink = Callable[[DataFrame, int], None]


def edit_events(spark: SparkSession, folder: str) -> DataFrame:
    """Edit events (see run.EVENT) from the JSON files of a folder, as a stream; `at` is when they were read."""
    return spark.readStream.schema(run.EVENT).json(folder).withColumn("at", F.current_timestamp())


def answer_edits(events: DataFrame, files: Callable[[], DataFrame], config: dict, trigger: str, sink: Sink, checkpoint: str, lifetime: str = "1 hour", **options: object) -> StreamingQuery:
    """Answers each edit event once: a second report of the same tool use within the lifetime is left out. files gives
    the files as they are when a batch is taken; sink gets (tool_use_id, exit_code, stderr, stdout) and the batch."""
    once = events.withWatermark("at", lifetime).dropDuplicatesWithinWatermark(["tool_use_id"])

    def answer(batch: DataFrame, k: int) -> None:
        sink(run.hook_answers(batch, files(), config, trigger), k)

    return once.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def watch_files(spark: SparkSession, folder: str, config: dict, trigger: str, sink: Sink, checkpoint: str, **options: object) -> StreamingQuery:
    """Checks the files of a folder as they come or are written anew; sink gets diagnostics and the batch."""
    written = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))

    def check(batch: DataFrame, k: int) -> None:
        sink(results.diagnostics(run.file_results(batch.select("path", text.alias("source")), config, trigger)), k)

    return written.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
