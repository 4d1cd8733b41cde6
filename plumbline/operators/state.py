"""Keyed state over event logs: grace, claims with a lifetime, cached results."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import CLAIM_SECONDS


def graced(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """events (passed, severity, trigger) with severity as grace leaves it: outside batch runs the first blocking
    failure after a pass, or ever, counts as advisory."""
    counts = (F.col("severity") == "blocking") & (F.col("trigger") != "batch")
    # events that don't count neither set nor clear: they look at the last one that did
    earlier = F.last(F.when(counts, F.col("passed")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    first = counts & ~F.col("passed") & F.coalesce(earlier, F.lit(True))
    return events.withColumn("severity", F.when(first, F.lit("advisory")).otherwise(F.col("severity")))


def claims(events: DataFrame, key: str, ts: str, order: str, seconds: int = CLAIM_SECONDS) -> DataFrame:
    """events with claimed: whether the event was the first of its key, or came over `seconds` after the last claim.

    The lifetime counts from the claim, so events are folded in order. Rows stream through sorted partitions with
    one number of state per key, so a key of any size needs no memory. Events without a key share one."""
    columns = [key, order, "_us"]
    picked = events.select(F.col(key), F.col(order), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    kinds = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in (key, order))

    def fold(batches):
        now, since, begun = None, 0, False
        for batch in batches:
            keys, times = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = np.zeros(len(keys), dtype=bool)
            for k, (x, t) in enumerate(zip(keys, times)):
                if not begun or x != now or t - since > seconds * 1_000_000:
                    now, since, begun, out[k] = x, t, True, True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=[key, order, "claimed"])

    return picked.select(*columns).repartition(key).sortWithinPartitions(key, "_us", order).mapInArrow(fold, f"{kinds}, claimed boolean")


def cache_lookup(asked: DataFrame, cached: DataFrame, key: str, stamps: list[str]) -> DataFrame:
    """asked with hit: whether the cache holds the key under the same trigger and the same stamps."""
    same = asked[key] == cached[key]
    for name in ["trigger", *stamps]:
        same = same & (asked[name] == cached[name])
    return asked.join(cached.select(key, "trigger", *stamps).withColumn("_hit", F.lit(True)), [key, "trigger", *stamps], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cache_merge(cached: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The cache after a run: one entry per key, the fresh one if there is one. A key has one entry whatever its
    trigger, so runs by different triggers put each other's entries out."""
    return cached.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def load_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries kept at path; none where there is nothing, or nothing that can be read."""
    try:
        found = spark.read.parquet(path)
        names = StructType.fromDDL(schema).fieldNames()
        found.select(*names).limit(1).count()  # reads a footer and a row: damage shows here
        return found.select(*names)
    except (AnalysisException, Py4JJavaError):
        return spark.createDataFrame([], schema)


def save_cache(entries: DataFrame, path: str) -> None:
    """Writes entries beside path and puts them in its place, so they may be read from there while they are written."""
    spark = entries.sparkSession
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    entries.write.parquet(new)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, to = files.Path(new), files.Path(path.rstrip("/"))
    system = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(to, True)
    system.rename(at, to)


CACHE = "path string, trigger string, modified timestamp, length long, config_modified timestamp, config_length long, results array<struct<check_name:string,severity:string,passed:boolean,output:string,message:string,command:string>>"


def cached_run(files: DataFrame, cached: DataFrame, trigger: str, config_stamp: tuple, check, scoped: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, cache after the run) of check (files -> results) over files (path, source, modified, length).

    Files whose entry has the same trigger and stamps, and was made under the same configuration, aren't checked
    again. A run scoped to changed lines neither reads the cache nor adds to it."""
    if scoped:
        return check(files.select("path", "source")), cached
    stamped = files.withColumn("trigger", F.lit(trigger)).withColumn("config_modified", F.lit(config_stamp[0]).cast("timestamp")).withColumn("config_length", F.lit(config_stamp[1]).cast("long"))
    stamps = ["modified", "length", "config_modified", "config_length"]
    asked = cache_lookup(stamped, cached, "path", stamps)
    old = asked.where("hit").select("path").join(cached, "path").select("path", F.explode("results").alias("r")).select("path", "r.*")
    missed = asked.where("not hit")
    new = check(missed.select("path", "source"))
    kept = new.groupBy("path").agg(F.collect_list(F.struct("check_name", "severity", "passed", "output", "message", "command")).alias("results"))
    fresh = missed.select("path", "trigger", *stamps).join(kept, "path", "left").withColumn("results", F.coalesce("results", F.array().cast(StructType.fromDDL(CACHE)["results"].dataType)))
    return old.unionByName(new.select(*old.columns)), cache_merge(cached, fresh, "path")


def with_baseline(current: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """current (passed, severity) against the same checks at the base revision: a blocking failure that was there
    already is advisory; an unknown base changes nothing."""
    return downgraded(current.join(head.select(*keys, F.col("passed").alias("base_passed")), keys, "left"))


def downgraded(judged: DataFrame) -> DataFrame:
    """judged (passed, severity, base_passed) with a blocking failure that was there already as advisory."""
    failed = ~F.col("passed") & (F.col("severity") == "blocking")
    return judged.withColumn("severity", F.when(failed & F.coalesce(~F.col("base_passed"), F.lit(False)), F.lit("advisory")).otherwise(F.col("severity")))


def pre_existing(after: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """after-findings (keys, message, ...) with pre_existing: the same message stood there before, on any line."""
    known = before.select(*keys, "message").distinct().withColumn("_there", F.lit(True))
    return after.join(known, [*keys, "message"], "left").withColumn("pre_existing", F.coalesce("_there", F.lit(False))).drop("_there")
