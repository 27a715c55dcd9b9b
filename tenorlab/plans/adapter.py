"""The stored tables' shapes over the driver's star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlab.sources.readers import table

TYPES = ("STANDARD", "MEDIUM", "LARGE", "SMALL")
TENORS = tuple(f"Brand#{i}" for i in range(1, 21))
LINKER_TENORS = tuple(f"Brand#{i}" for i in range(1, 16))


def auctions(spark: SparkSession, sf: str) -> DataFrame:
    """A part is an issue, its shipments are its auctions; its last day is aggregated before the join."""
    ship = table(spark, sf, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("auction_date"))
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    last = ship.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("auction_date").alias("maturity_date"))
    rows = ship.join(part.join(last, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("p_partkey").cast("string").alias("cusip"), "auction_date", "maturity_date",
        F.col("p_brand").alias("original_security_term"), F.col("p_type").alias("security_type"), F.when(F.col("p_size") % 4 == 0, "Yes").otherwise("No").alias("inflation_index_security"),
    )


def eod(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("ts"), F.col("l_partkey").cast("string").alias("cusip"))
    return rows.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("px_last"), F.avg("l_discount").alias("yld_ytm_mid"))


def order_series(spark: SparkSession, sf: str) -> DataFrame:
    """One series: the mean order price of each day."""
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("value"))
    return days.select(F.lit("orders").alias("series"), "ts", "value")


def ticks(rows: DataFrame) -> DataFrame:
    """Events as ticks; rows may be a stream."""
    return rows.select(
        F.col("event_type").alias("security"), F.col("ts").cast("timestamp").alias("time"), F.when(F.col("event_id") % 3 == 0, "BID").otherwise("TRADE").alias("type"),
        "value", F.get_json_object("props", "$.k").cast("long").alias("size"), F.format_string("C%d", F.col("event_id") % 4).alias("conditionCodes"), F.col("event_id").alias("seq"),
    )


def updates(rows: DataFrame) -> DataFrame:
    """Events as partial updates: each carries one price field, and a size with every other bid or ask."""
    k = F.get_json_object("props", "$.k").cast("long")
    only = lambda r, c: F.when(F.col("event_id") % 3 == r, c)
    even = F.col("event_id") % 2 == 0
    return rows.select(
        F.col("event_type").alias("security"), F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_id").alias("seq"),
        only(0, F.col("value")).alias("LAST_PRICE"), only(1, F.col("value")).alias("BID"), only(2, F.col("value")).alias("ASK"),
        F.when(even, only(1, k)).alias("BID_SIZE"), F.when(even, only(2, k)).alias("ASK_SIZE"),
    )


def flags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("click", True), ("view", True), ("refund", True)], "security string, use_ticks boolean")
