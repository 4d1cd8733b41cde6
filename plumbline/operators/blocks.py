"""Repeated blocks of lines within a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BLOCK_BYTES, BLOCK_LINES, BLOCK_REPEATS
from ..functions.text import lines, trimmed


def numbered_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line from 1, text) of every line."""
    return files.select(key, F.posexplode(lines(F.col(text))).alias("at", "line_text")).select(key, (F.col("at") + 1).alias("line"), F.col("line_text").alias("text"))


def repeated_windows(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, starts): windows of lines that stand at least BLOCK_REPEATS times in a file, without empty lines and
    with enough bytes. A row is a file. Windows are told apart by a hash inside each row, so only those whose hash
    is repeated leave it; these are grouped by their text."""
    ls = F.col("ls")
    window = lambda start: F.slice(ls, start + 1, F.lit(BLOCK_LINES))
    own = files.select(key, F.transform(lines(F.col(text)), trimmed).alias("ls")).where(F.size("ls") >= BLOCK_LINES + BLOCK_REPEATS - 1)
    told = F.transform(F.sequence(F.lit(0), F.size(ls) - BLOCK_LINES), lambda k: F.struct(F.xxhash64(window(k)).alias("h"), k.alias("start")))
    # in the order of their hashes, equal windows stand side by side
    beside = [(k, k + BLOCK_REPEATS - 1) for k in range(1 - BLOCK_REPEATS, 1)]

    def repeated(x, k):
        at = lambda j: F.get("sorted", k + j)["h"]
        out = F.lit(False)
        for a, b in beside:
            out = out | ((k + a >= 0) & F.coalesce((at(a) == x["h"]) & (at(b) == x["h"]), F.lit(False)))
        return out

    each = own.withColumn("sorted", F.array_sort(told)).select(key, "ls", F.explode(F.filter("sorted", repeated)["start"]).alias("start"))
    each = each.select(key, "start", window(F.col("start")).alias("w"))
    size = F.aggregate("w", F.lit(0), lambda a, x: a + F.octet_length(x))
    good = each.where(~F.array_contains("w", "") & (size >= BLOCK_BYTES))
    found = good.groupBy(key, F.array_join("w", "\n").alias("w")).agg(F.sort_array(F.collect_list("start")).alias("starts"))
    return found.where(F.size("starts") >= BLOCK_REPEATS).select(key, "starts")


def duplicate_blocks(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, repeats, lines): one row per repeated block; windows that begin inside a block told of before
    are left out. line is that of the last occurrence."""
    grouped = repeated_windows(files, key, text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("starts")[0].alias("first"), "starts"))).alias("groups"))
    start = F.struct(F.lit(0).alias("until"), F.array().cast("array<array<int>>").alias("told"))

    def step(a, g):
        taken = F.struct((g["first"] + BLOCK_LINES).alias("until"), F.concat(a["told"], F.array(g["starts"])).alias("told"))
        return F.when(g["first"] < a["until"], a).otherwise(taken)

    told = grouped.select(key, F.explode(F.aggregate("groups", start, step, lambda a: a["told"])).alias("starts"))
    return told.select(
        key,
        (F.element_at("starts", -1) + 1).cast("long").alias("line"),
        F.size("starts").cast("long").alias("repeats"),
        F.array_join(F.transform("starts", lambda s: (s + 1).cast("string")), ", ").alias("lines"),
    )
