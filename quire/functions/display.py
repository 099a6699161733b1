"""Human-readable text of sizes, times and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB = 1024.0
MB = KB * 1024
GB = MB * 1024


def _scaled(size: Column, unit: float, decimals: int, label: str) -> Column:
    """Half-even rounding, as C and Python format exact halves; Java's own formatting rounds them up."""
    return F.format_string(f"%.{decimals}f {label}", F.bround(size / unit, decimals))


def format_bytes(size: Column) -> Column:
    """B, KB (1 decimal), MB and GB (2 decimals)."""
    return (
        F.when(size < KB, F.format_string("%d B", size.cast("bigint")))
        .when(size < MB, _scaled(size, KB, 1, "KB"))
        .when(size < GB, _scaled(size, MB, 2, "MB"))
        .otherwise(_scaled(size, GB, 2, "GB"))
    )


def format_item_size(size: Column) -> Column:
    """The queue's item size, which stops at MB."""
    return F.when(size < MB, format_bytes(size)).otherwise(_scaled(size, MB, 2, "MB"))


def format_volume(size: Column) -> Column:
    """The queue's total volume: MB (1 decimal) or GB (2 decimals)."""
    return F.when(size < GB, _scaled(size, MB, 1, "MB")).otherwise(_scaled(size, GB, 2, "GB"))


def utc_text(time: Column) -> Column:
    """A timestamp as UTC text, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def format_utc(seconds: Column) -> Column:
    """Epoch seconds as UTC text."""
    return utc_text(F.timestamp_seconds(seconds))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.80, "high").when(score >= 0.60, "moderate").otherwise("low")


def score_percent(score: Column) -> Column:
    return F.round(score * 100.0, 1)
