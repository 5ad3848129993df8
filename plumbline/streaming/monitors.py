"""Structured Streaming forms: chain checks with state, and drift of windows against a reference (replay: replay.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions.statistics import js_bits
from plumbline.streaming.replay import BUCKETS

LINKS = "log_id string, line long, sequence long, digest string, link string, in_sequence boolean"


class Links(StatefulProcessor):
    """Links of a bucket of logs in order of arrival; a late record breaks its chain and is not sorted away.

    State: for each log, the digest of its last entry and the next sequence number, whatever its length.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.logs = handle.getMapState("logs", "log_id string", "last string, expected long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shown = pd.concat(list(rows), ignore_index=True).sort_values(["log_id", "line"], ignore_index=True, kind="stable")
        own = shown.groupby("log_id", sort=False, dropna=False)
        start, size = np.flatnonzero(own.cumcount() == 0), own.size().to_numpy()
        ids = [None if pd.isna(log) else log for log in shown["log_id"].iloc[start]]
        held = [self.logs.getValue((log,)) or (None, 0) for log in ids]
        expected = np.array([h[1] for h in held], np.int64)
        position = own.cumcount().to_numpy() + np.repeat(expected, size)
        before = shown["digest"].shift(1).astype(object)
        before.iloc[start] = [h[0] for h in held]
        none = shown["previous"].isna()
        link = pd.Series("BROKEN", index=shown.index).mask(~none & (shown["previous"] == before), "LINKED")
        first = position == 0
        link = link.mask(first & none, "GENESIS").mask(first & ~none, "ORPHANED")
        for log, last, n in zip(ids, shown["digest"].iloc[start + size - 1], (expected + size).tolist(), strict=True):
            self.logs.updateValue((log,), (None if pd.isna(last) else last, n))
        yield pd.DataFrame({"log_id": shown["log_id"], "line": shown["line"], "sequence": shown["sequence"], "digest": shown["digest"], "link": link, "in_sequence": shown["sequence"] == position})

    def close(self) -> None:
        pass


def verify_stream(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of records (log_id, line, sequence, digest, previous) -> links as they arrive, one small entry of state for each log.

    Logs are dealt to buckets, so that a micro-batch calls Python once for a bucket and not for each log.  It is to be
    started within replay.map_state(); a restart keeps the number of buckets.
    """
    bucket = F.pmod(F.xxhash64("log_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = records.select(bucket, "log_id", "line", "sequence", "digest", "previous")
    return rows.groupBy("bucket").transformWithStateInPandas(Links(), LINKS, "Append", "None")


def distinct_records(records: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Drops exact repeats within a watermark: the retention that is declared for replays."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(["log_id", "digest"])


def window_counts(events: DataFrame, time: str = "ts", category: str = "event_type", width: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and category, closed by a watermark."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), F.col(category).alias("category")).agg(F.count("*").alias("n"))


def drift(windows: DataFrame, reference: DataFrame) -> DataFrame:
    """Closed windows (w, category, n) against a reference (category, n): Jensen-Shannon divergence in bits by window."""
    ref = reference.withColumn("p", F.col("n") / F.lit(reference.agg(F.sum("n")).first()[0])).select("category", "p")
    starts = windows.select("w").distinct()
    full = starts.crossJoin(F.broadcast(ref)).join(windows, ["w", "category"], "full").fillna(0, ["n", "p"])  # categories are few
    total = full.groupBy("w").agg(F.sum("n").alias("all"))
    return full.join(total, "w").groupBy(F.col("w.start").alias("start")).agg(F.round(F.sum(js_bits(F.col("p"), F.col("n") / F.col("all"))), 9).alias("js"), F.max("all").alias("n"))
