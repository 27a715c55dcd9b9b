"""Intraday bars, ticks and period resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIODS = {"DAILY": "day", "WEEKLY": "week", "MONTHLY": "month", "QUARTERLY": "quarter", "YEARLY": "year"}


def bar_aggregates(value: str = "value", size: str = "size", order: Sequence[str] = ("time",)) -> list[Column]:
    """open, high, low, close, volume, numEvents; ``order`` settles which tick is first and last."""
    at = F.struct(*order)
    return [
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
        F.sum(size).cast("long").alias("volume"), F.count(F.lit(1)).alias("numEvents"),
    ]


def intraday_bars(ticks: DataFrame, minutes: int = 5, order: Sequence[str] = ("time",)) -> DataFrame:
    """security, time (the bar's start) and the bar, from ticks (security, time, value, size)."""
    out = ticks.groupBy("security", F.window("time", f"{minutes} minutes").alias("w")).agg(*bar_aggregates(order=order))
    return out.select("security", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume", "numEvents")


def fill_gaps(bars: DataFrame, minutes: int = 5) -> DataFrame:
    """A bar at every step between a security's first and last; an empty bar repeats the last close with no volume."""
    span = bars.groupBy("security").agg(F.min("time").alias("a"), F.max("time").alias("b"))
    grid = span.select("security", F.explode(F.sequence("a", "b", F.expr(f"interval {minutes} minutes"))).alias("time"))
    w = Window.partitionBy("security").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(bars, ["security", "time"], "left").withColumn("last", F.last("close", ignorenulls=True).over(w))
    price = [F.coalesce(c, "last").alias(c) for c in ("open", "high", "low", "close")]
    return full.select("security", "time", *price, F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), F.coalesce("numEvents", F.lit(0)).cast("long").alias("numEvents"))


def intraday_ticks(ticks: DataFrame, security: str, start, end, types: Sequence[str] = ("TRADE",), condition_codes: bool = False) -> DataFrame:
    """One security's ticks of the given types in [start, end), with full time stamps."""
    kept = ticks.where((F.col("security") == security) & F.col("type").isin(*types) & (F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(end)))
    return kept.select("time", "type", "value", "size", *(["conditionCodes"] if condition_codes else []))


def resample(history: DataFrame, fields: Sequence[str], periodicity: str = "DAILY", day: str = "date") -> DataFrame:
    """The last observation of each field in each period; a missing value never hides an earlier one."""
    period = F.to_date(F.date_trunc(PERIODS[periodicity], day))
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(day))).alias(f) for f in fields]
    return history.groupBy("security", period.alias("period")).agg(*last)
