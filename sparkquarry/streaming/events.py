"""Streaming forms of the run-state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each type and day, batch or stream; `events` has ts (timestamp) and event_type."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    day = F.window("ts", "1 day")
    return events.groupBy(day, "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def busy_periods(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Of every run (run, ts) the periods in which it said something at least once a `gap`, batch or stream:
    run, start, stop (a gap after the last line) and lines. A run that has no open period is to be restarted."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    period = F.session_window("ts", gap)
    found = events.groupBy("run", period).agg(F.count("*").alias("lines"))
    return found.select("run", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "lines")


def log_counts(lines: DataFrame) -> DataFrame:
    """Of every run (run, line) how much it has searched, skipped and added, batch or stream; lines are told apart by their start."""
    of = lambda start: F.count_if(F.ltrim("line").startswith(start))
    return lines.groupBy("run").agg(of("Search: ").alias("searched"), of("Skipped: ").alias("skipped"), of("Added row ").alias("added"))
