"""Replay of edit logs: snapshots of files before and after each edit, and which findings were there before."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_scope
from .state import pre_existing

SNAPSHOT = "transcript string, seq int, path string, before string, after string, lost int"


def _numbered(text: str) -> str | None:
    lines = re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", text)) if text else []
    return "\n".join(x.split("\t", 1)[1] for x in lines) if all("\t" in x for x in lines) else None


def replay(records: Iterator[dict]) -> tuple[list[tuple], int]:
    """(seq from 1, path, before, after) of each edit that can be followed, and how many can't."""
    records = [r for r in records if isinstance(r, dict)]
    blocks = [(r.get("type"), b) for r in records for b in ((r.get("message") or {}).get("content") or []) if isinstance(b, dict)]
    results = {}
    for kind, b in blocks:
        if kind == "user" and b.get("type") == "tool_result" and b.get("tool_use_id"):
            content = b.get("content")
            if isinstance(content, list):
                content = next((x.get("text") for x in content if isinstance(x, dict) and x.get("type") == "text"), None)
            if isinstance(content, str):
                results[b["tool_use_id"]] = content
    known, out, lost = {}, [], 0
    for kind, b in blocks:
        if kind != "assistant" or b.get("type") != "tool_use":
            continue
        name, given = b.get("name"), b.get("input") or {}
        path = given.get("file_path")
        if not isinstance(path, str):
            continue
        if name == "Read":
            text = results.get(b.get("id"))
            if "offset" not in given and "limit" not in given and text is not None and (text := _numbered(text)) is not None:
                known[path] = text
        elif name == "Write" and isinstance(given.get("content"), str):
            known[path] = given["content"]
            out.append((len(out) + 1, path, None, given["content"]))
        elif name in ("Edit", "MultiEdit"):
            edits = [given] if name == "Edit" else given.get("edits")
            told = isinstance(edits, list) and all(isinstance(e, dict) and isinstance(e.get(k), str) for e in edits for k in ("old_string", "new_string"))
            if not told and (name == "Edit" or not isinstance(edits, list)):
                continue  # nothing to follow
            before = now = known.get(path)
            if before is None:
                lost += max(len(edits), 1)
                continue
            for e in edits if told else ():
                now = now.replace(e["old_string"], e["new_string"], 1) if now is not None and e["old_string"] in now else None
            if now is None or not told:
                lost += 1
            else:
                known[path] = now
                out.append((len(out) + 1, path, before, now))
    return out, lost


def snapshots(transcripts: DataFrame) -> DataFrame:
    """Snapshots of transcripts (transcript, line_no, raw); one extra row per transcript, without path, says how many
    edits couldn't be followed. Lines that aren't JSON are skipped. The fold needs a transcript's records in order,
    so a transcript (one session's log) is one group."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        records = []
        for raw in pdf.sort_values("line_no")["raw"]:
            try:
                records.append(json.loads(raw))
            except (TypeError, ValueError):
                pass
        found, lost = replay(iter(records))
        name = pdf["transcript"].iloc[0]
        return pd.DataFrame([(name, *s, 0) for s in found] + [(name, -1, None, None, None, lost)], columns=["transcript", "seq", "path", "before", "after", "lost"])

    return transcripts.select("transcript", "line_no", "raw").groupBy("transcript").applyInPandas(fold, SNAPSHOT)


def backtest(snaps: DataFrame, check, only_new: bool = False) -> DataFrame:
    """Findings of check (files -> findings) on each snapshot's after, with pre_existing where its before is known
    and has a finding of the same message."""
    real = snaps.where("path is not null")
    # a snapshot is a file of its own: its place in the log goes in front of its name, lengths first
    at = F.concat(F.length("transcript").cast("string"), F.lit("/"), "transcript", F.lit("/"), F.col("seq").cast("string"), F.lit("/"), "path")
    after = check(real.select(at.alias("path"), F.col("after").alias("source")))
    before = check(real.where("before is not null").select(at.alias("path"), F.col("before").alias("source")))
    out = pre_existing(after, before, ["path", "rule"])
    size = F.split_part("path", F.lit("/"), F.lit(1))
    rest = F.substring("path", F.length(size) + size.cast("int") + 3, F.length("path"))
    seq = F.split_part(rest, F.lit("/"), F.lit(1))
    out = out.select(F.substring("path", F.length(size) + 2, size.cast("int")).alias("transcript"), seq.cast("int").alias("seq"), F.substring(rest, F.length(seq) + 2, F.length(rest)).alias("path"), "line", "rule", "message", "pre_existing")
    return out.where("not pre_existing") if only_new else out


def backtest_lines(findings: DataFrame) -> DataFrame:
    """findings of backtest with text: one line each."""
    old = F.when(F.col("pre_existing"), " (pre-existing)").otherwise("")
    return findings.withColumn("text", F.concat("transcript", F.lit("#"), F.col("seq").cast("string"), F.lit(" "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(": ["), "rule", F.lit("]"), old, F.lit(" "), "message"))


def backtest_counts(snaps: DataFrame, globs: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: transcripts, snapshots (each as often as checkers look at its file) and edits that were lost. globs:
    by checker, the paths that it looks at."""
    seen = sum((in_scope(F.col("path"), list(g)).cast("long") for g in globs.values()), F.lit(0).cast("long"))
    return snaps.agg(F.countDistinct("transcript").alias("transcripts"), F.coalesce(F.sum(F.when(F.col("path").isNotNull(), seen)), F.lit(0)).alias("snapshots"), F.coalesce(F.sum("lost"), F.lit(0)).cast("long").alias("lost"))
