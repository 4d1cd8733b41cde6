"""Which checks see which files, and which findings lie in changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_scope, lines


def started(checks: list[dict], trigger: str) -> list[dict]:
    """The checks that the trigger starts; one that names no trigger is started by any."""
    return [c for c in checks if not c.get("triggers") or trigger in c["triggers"]]


def selected_checks(files: DataFrame, checks: list[dict], trigger: str, path: str = "path") -> DataFrame:
    """files x check_name for the checks that the trigger starts and whose scope holds the path. checks is the
    configuration (small by nature); scopes become one predicate per check, so no join is needed."""
    parts = [F.when(in_scope(F.col(path), c.get("scope", [])), F.lit(c["name"])) for c in started(checks, trigger)]
    if not parts:
        return files.withColumn("check_name", F.lit("")).where("false")
    return files.withColumn("check_name", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())))


def findings_in_ranges(findings: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Findings whose line lies in some range (start, end; from 1, both included) of the same file."""
    r = ranges.select(F.col(key).alias("_key"), "start", "end")
    return findings.join(r, (findings[key] == r["_key"]) & findings["line"].between(r["start"], r["end"]), "left_semi")


def scoped_output(results: DataFrame) -> DataFrame:
    """path, output, ranges (array of start, end), passed -> kept, passed. Lines that name a line of the file outside
    all ranges go; what can't be attributed stays and counts as failure; without any attributed line nothing changes."""
    prefix = F.concat("path", F.lit(":"))

    def judged(x):
        told = F.startswith(x, prefix)
        number = F.split_part(F.substring(x, F.length(prefix) + 1, F.length(x)), F.lit(":"), F.lit(1))
        line = F.when(told & number.rlike(r"\A\+?[0-9]+\z"), F.try_to_number(F.regexp_replace(number, r"\+", ""), F.lit("999999999999999999")).cast("long"))
        near = F.exists("ranges", lambda r: (line >= r["start"]) & (line <= r["end"]))
        return F.struct(x.alias("x"), line.isNotNull().alias("attributed"), F.when(line.isNotNull(), near).otherwise(F.lit(True)).alias("stays"), ((line.isNotNull() & near) | (line.isNull() & (x != ""))).alias("fails"))

    all_lines = F.transform(lines(F.col("output")), judged)
    out = results.withColumn("_j", all_lines)
    whole = F.col("passed") | F.coalesce(F.size("ranges") <= 0, F.lit(True)) | ~F.exists("_j", lambda j: j["attributed"])
    kept = F.array_join(F.transform(F.filter("_j", lambda j: j["stays"]), lambda j: j["x"]), "\n")
    return out.withColumn("kept", F.when(whole, F.col("output")).otherwise(kept)).withColumn("passed", F.when(whole, F.col("passed")).otherwise(~F.exists("_j", lambda j: j["stays"] & j["fails"]))).drop("_j")


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """(path, ord, old_start, old_count, new_start, new_count) of unified diffs (path, diff); a missing count is 1."""
    at = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    heads = diffs.select("path", F.posexplode(lines(F.col("diff"))).alias("pos", "x")).where(F.col("x").rlike(at))
    ord_ = F.row_number().over(Window.partitionBy("path").orderBy("pos")).alias("ord")
    part = lambda k: F.regexp_extract("x", at, k)
    count = lambda k: F.when(part(k) == "", F.lit(1)).otherwise(part(k).cast("int"))
    return heads.select("path", ord_, part(1).cast("int").alias("old_start"), count(2).alias("old_count"), part(3).cast("int").alias("new_start"), count(4).alias("new_count"))


def ranges_before(ranges: DataFrame, hunks: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of ranges in the old file. The first hunk that ends at or after the range decides: if the
    range reaches its new lines, its old span stands for the range (none, if nothing was there); otherwise the range
    moves by what the hunks before it have added."""
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    new_end = F.when(F.col("new_count") == 0, F.col("new_start")).otherwise(F.col("new_start") + F.col("new_count") - 1)
    delta = F.col("new_count") - F.col("old_count")
    h = hunks.withColumn("shift", F.coalesce(F.sum(delta).over(before), F.lit(0))).withColumn("new_end", new_end).withColumn("delta", delta)
    both = ranges.select(key, "start", "end").join(h, key, "left")
    first = F.min(F.when(F.col("new_end") >= F.col("start"), F.struct("ord", "old_start", "old_count", "new_start", "new_count", "shift"))).alias("h")
    told = both.groupBy(key, "start", "end").agg(first, F.coalesce(F.sum("delta"), F.lit(0)).alias("total"))
    hit = F.coalesce((F.col("h.new_count") > 0) & (F.col("end") >= F.col("h.new_start")), F.lit(False))
    offset = F.coalesce(F.col("h.shift"), F.col("total"))
    told = told.where(~(hit & F.coalesce(F.col("h.old_count") == 0, F.lit(False))))
    return told.select(
        key,
        F.col("start").alias("new_start"),
        F.col("end").alias("new_end"),
        F.when(hit, F.col("h.old_start")).otherwise(F.greatest(F.col("start") - offset, F.lit(1))).cast("long").alias("old_start"),
        F.when(hit, F.col("h.old_start") + F.col("h.old_count") - 1).otherwise(F.greatest(F.col("end") - offset, F.lit(1))).cast("long").alias("old_end"),
    )
