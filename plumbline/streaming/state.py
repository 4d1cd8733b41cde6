"""The keyed states as streams: grace and claim-once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRACED = "file string, check_name string, event_id long, severity string"


def graced_stream(events: DataFrame) -> DataFrame:
    """events (file, check_name, event_id, ts, trigger, severity, passed) as a stream with graced severities; a key's
    state is whether its last counted event failed. Within a micro-batch events are taken by ts and event_id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            severity = r.severity
            if severity == "blocking" and r.trigger != "batch":
                if r.passed:
                    pending = False
                else:
                    severity = "blocking" if pending else "advisory"
                    pending = True
            out.append((key[0], key[1], r.event_id, severity))
        state.update((pending,))
        yield pd.DataFrame(out, columns=["file", "check_name", "event_id", "severity"])

    return events.groupBy("file", "check_name").applyInPandasWithState(step, GRACED, "pending boolean", "append", "NoTimeout")


def claimed_stream(events: DataFrame, key: str, ts: str, lifetime: str = "1 hour") -> DataFrame:
    """The first event of each key within the lifetime; state goes with the watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lifetime)
    return timed.dropDuplicatesWithinWatermark([key])
