"""Last-value state and quote lines; the same plans serve batch rows and micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenorlab.functions.scalars import price_32nds

FIELDS = ("LAST_PRICE", "BID", "ASK", "BID_SIZE", "ASK_SIZE")


def last_values(updates: DataFrame, fields: Sequence[str] = FIELDS, order: Sequence[str] = ("event_ts", "seq")) -> DataFrame:
    """Per security the latest value of each field and the latest event time; a null never overwrites.

    Ordered by event, not by arrival, and partial by nature: one row per security and task is shuffled.
    """
    at = lambda f: F.when(F.col(f).isNotNull(), F.struct(*order))
    return updates.groupBy("security").agg(*[F.max_by(f, at(f)).alias(f) for f in fields], F.max(order[0]).alias("last_ts"))


def quote_lines(cache: DataFrame, flags: DataFrame) -> DataFrame:
    """security, use_ticks and a line of time, name and the available fields, prices in 32nds; the flag defaults to false."""
    known = cache.join(flags, "security", "left").withColumn("ticks", F.coalesce("use_ticks", F.lit(False)))
    part = lambda label, c, shown: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), shown))
    parts = [part(label, c, price_32nds(F.col(c))) for label, c in (("Last", "LAST_PRICE"), ("Bid", "BID"), ("Ask", "ASK")) if c in cache.columns]
    parts += [part(label, c, F.col(c).cast("string")) for label, c in (("BidSz", "BID_SIZE"), ("AskSz", "ASK_SIZE")) if c in cache.columns]
    when = F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss")
    return known.select("security", F.col("ticks").alias("use_ticks"), F.concat_ws(" | ", when, F.col("security"), *parts).alias("line"))
