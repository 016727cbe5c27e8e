"""Windows of requests, and event times."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def window_ms(window: str) -> int:
    """Milliseconds of Ns, Nm, Nh or Nd, N above 0."""
    m = re.fullmatch(r"\s*(\d+)([smhd])\s*", window or "")
    if not m or int(m[1]) == 0:
        raise ValueError(f"bad window {window!r}: a number above 0 with s, m, h or d")
    span = int(m[1]) * _UNITS[m[2]]
    if span >= 1 << 63:
        raise ValueError(f"window {window!r} is too long")
    return span


def resolved(window: str | None, end_ms: int | None = None) -> tuple[int, int] | None:
    """First and last millisecond of a window that ends at end_ms (now, if None)."""
    if window is None:
        return None
    end = int(time.time() * 1000) if end_ms is None else end_ms
    return end - window_ms(window), end


def selected(table: DataFrame, headers: DataFrame, latest: int | None = None, window: str | None = None, end_ms: int | None = None) -> DataFrame:
    """Rows of an epoch table in the latest distinct sequences (which go first) or in the ingest-time window.

    The set of sequences is a semi join: its size is `latest` at most, or that of the window.
    """
    if latest is not None:
        if latest <= 0:
            raise ValueError("latest must be above 0")
        return table.join(F.broadcast(headers.select("sequence").distinct().orderBy(F.desc("sequence")).limit(latest)), "sequence", "left_semi")
    span = resolved(window, end_ms)
    if span is None:
        return table
    in_window = F.col("ingest_time_ms").between(*span)
    if "ingest_time_ms" in table.columns:
        return table.where(in_window)
    return table.join(headers.where(in_window).select("aggregator_id", "sequence").distinct(), ["aggregator_id", "sequence"], "left_semi")


def year_ts(year: Column) -> Column:
    """Seconds of the first of January of a year, UTC."""
    return F.date_diff(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long") * 86_400


def spaced_ts(base: Column | int, nth: Column, interval_s: int = 1) -> Column:
    """base + interval * n for the n-th event, n from 0."""
    return (F.lit(base) if isinstance(base, int) else base) + nth.cast("long") * interval_s
