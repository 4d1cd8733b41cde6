"""Check results as reports: SARIF logs, console lines, diagnostics, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import described

SARIF = "runs array<struct<results: array<struct<level: string, ruleId: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: bigint>>>>>>>>"


def _sarif_array(log: Column) -> Column:
    """All results of a log in order, as an array; null for what isn't a log. A missing level is a warning."""
    every = F.flatten(F.filter(F.transform(F.from_json(log, SARIF)["runs"], lambda r: r["results"]), lambda x: x.isNotNull()))

    def told(r: Column) -> Column:
        at = F.get(r["locations"], F.lit(0))["physicalLocation"]
        return F.struct(F.coalesce(r["level"], F.lit("warning")).alias("level"), r["ruleId"].alias("rule"), r["message"]["text"].alias("text"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("line"))

    return F.transform(every, told)


def sarif_results(logs: DataFrame, keys: list[str], log: str = "log") -> DataFrame:
    """(keys, ord, level, rule, text, uri, line) of every result in order; a missing level is a warning."""
    return logs.select(*keys, F.posexplode(_sarif_array(F.col(log))).alias("ord", "r")).select(*keys, "ord", "r.level", "r.rule", "r.text", "r.uri", "r.line")


def sarif_line(uri: Column, line: Column, level: Column, text: Column, rule: Column) -> Column:
    place = F.when(uri.isNull(), F.lit("")).when(line.isNull(), F.concat(uri, F.lit(": "))).otherwise(F.concat(uri, F.lit(":"), line.cast("string"), F.lit(": ")))
    return F.concat(place, F.lit("["), level, F.lit("] "), text, F.coalesce(F.concat(F.lit(" ("), rule, F.lit(")")), F.lit("")))


def sarif_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header): counts by level in alphabetical order."""
    n = results.groupBy(*keys, "level").agg(F.count("*").alias("n"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("level", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["level"], F.lit("(s)")))
    return n.groupBy(*keys).agg(F.array_join(told, ", ").alias("header"))


def sarif_report(logs: DataFrame, keys: list[str], log: str = "log") -> DataFrame:
    """(keys, output): the header and a line per result; `0 findings` without results, null for what isn't a log.
    A log is one row, so nothing is shuffled."""
    of = F.col("_r")
    levels = F.array_sort(F.array_distinct(of["level"]))
    header = F.array_join(F.transform(levels, lambda x: F.concat(F.size(F.filter(of, lambda r: r["level"] == x)).cast("string"), F.lit(" "), x, F.lit("(s)"))), ", ")
    body = F.transform(of, lambda r: sarif_line(r["uri"], r["line"], r["level"], r["text"], r["rule"]))
    told = F.when(F.size(of) == 0, F.lit("0 findings")).otherwise(F.array_join(F.concat(F.array(header), body), "\n"))
    return logs.withColumn("_r", _sarif_array(F.col(log))).select(*keys, F.when(of.isNotNull(), told).alias("output"))


def console_lines(results: DataFrame, path: str = "path") -> DataFrame:
    """Failures as lines of a batch report."""
    grade = F.when(F.col("severity") == "blocking", "BLOCKING").otherwise("advisory")
    text = F.concat(F.lit("["), grade, F.lit("] "), F.col(path), F.lit(" — "), F.col("check_name"), F.lit(": "), described(F.col("message"), F.col("output"), F.col("command")))
    return results.where("not passed").withColumn("report", text)


def exit_codes(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: batch exit code (1 if a blocking check failed) and hook exit code (2 if so, else 0)."""
    bad = F.coalesce(F.bool_or(~F.col("passed") & (F.col("severity") == "blocking")), F.lit(False))
    return results.groupBy(*keys).agg(F.when(bad, 1).otherwise(0).cast("long").alias("batch_code"), F.when(bad, 2).otherwise(0).cast("long").alias("hook_code"))


def hook_responses(results: DataFrame, keys: list[str], note: str) -> DataFrame:
    """(keys, exit_code, stderr, stdout): blocking failures alone on stderr; else advisories and the note as JSON."""
    told = described(F.col("message"), F.col("output"), F.col("command"))
    r = results.where("not passed").select(*keys, "check_name", "severity", told.alias("told"))
    both = r.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("severity") == "blocking", F.concat("check_name", F.lit(" (blocking): "), "told")))).alias("hard"),
        F.array_sort(F.collect_list(F.concat("check_name", F.lit(": "), "told"))).alias("all"),
    )
    blocking = F.size("hard") > 0
    context = F.concat(F.array_join("all", "\n"), F.lit("\n\n" + note))
    payload = F.to_json(F.struct(F.struct(F.lit("PostToolUse").alias("hookEventName"), context.alias("additionalContext")).alias("hookSpecificOutput")))
    told_all = both.select(*keys, F.when(blocking, 2).otherwise(0).alias("exit_code"), F.when(blocking, F.array_join("hard", "\n")).alias("stderr"), F.when(~blocking, payload).alias("stdout"))
    quiet = results.select(*keys).distinct().join(told_all, keys, "left")
    return quiet.na.fill(0, ["exit_code"])


def diagnostics(results: DataFrame, path: str = "path") -> DataFrame:
    """(path, line from 0, severity, source, message): one per output line `path:line: text` about the file; else one
    at line 0. What isn't a number of 32 bits names no line."""
    prefix = F.concat(F.col(path), F.lit(":"))
    failed = results.where("not passed").withColumn("_lines", F.split("output", r"\r?\n", -1))
    rest = F.transform(F.filter("_lines", lambda x: F.startswith(x, prefix) & (F.instr(F.substring(x, F.length(prefix) + 1, F.length(x)), ":") > 0)), lambda x: F.substring(x, F.length(prefix) + 1, F.length(x)))
    number = lambda x: F.when(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).rlike(r"\A\+?[0-9]+\z"), F.trim(F.split_part(x, F.lit(":"), F.lit(1))).try_cast("bigint"))
    own = F.filter(rest, lambda x: F.coalesce(number(x) < 1 << 32, F.lit(False)))
    spots = F.transform(own, lambda x: F.struct(F.greatest(number(x) - 1, F.lit(0)).alias("line"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("text")))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("line"), described(F.col("message"), F.col("output"), F.col("command")).alias("text")))
    each = failed.withColumn("_d", F.explode(F.when(F.size(spots) > 0, spots).otherwise(whole)))
    return each.select(path, F.col("_d.line").alias("line"), F.when(F.col("severity") == "blocking", "ERROR").otherwise("WARNING").alias("severity"), F.col("check_name").alias("source"), F.col("_d.text").alias("message"))


def joined_output(findings: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """(keys, path, output): findings as lines `path:line: message`, by line."""
    told = F.array_sort(F.collect_list(F.struct("line", "message")))  # in the order of lines
    return findings.groupBy(*keys, path).agg(output_lines(F.col(path), told).alias("output"))


def output_lines(path: Column, told: Column) -> Column:
    """An array of struct(line, message) as lines `path:line: message`."""
    return F.array_join(F.transform(told, lambda x: F.concat_ws("", path, F.lit(":"), x["line"].cast("string"), F.lit(": "), x["message"])), "\n")


def rollup(parts: dict[str, DataFrame]) -> DataFrame:
    """(check_name, findings, files) over several tables of findings (path, line)."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("findings"), F.countDistinct("path").alias("files")).select(F.lit(name).alias("check_name"), "findings", "files")
        out = one if out is None else out.unionByName(one)
    return out
