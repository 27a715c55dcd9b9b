"""Issue ranking and breakeven pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenorlab.functions.scalars import asset_class, status_label

#: Terms and types of coupon issues.
HEADLINE_TENORS = ("2-Year", "3-Year", "5-Year", "7-Year", "10-Year", "20-Year", "30-Year")
BREAKEVEN_TENORS = ("5-Year", "10-Year", "20-Year", "30-Year")
COUPON_TYPES = ("Note", "Bond")
RANKS = 5


def first_auctions(auctions: DataFrame, types: Sequence[str] = COUPON_TYPES, tenors: Sequence[str] = HEADLINE_TENORS) -> DataFrame:
    """cusip, tenor, flag, first_auction_date, maturity_date: a reopening never moves an issue."""
    kept = auctions.where(F.col("security_type").isin(*types) & F.col("original_security_term").isin(*tenors))
    return kept.groupBy("cusip", F.col("original_security_term").alias("tenor"), F.col("inflation_index_security").alias("flag")).agg(
        F.min("auction_date").alias("first_auction_date"), F.max("maturity_date").alias("maturity_date")
    )


def tips_first_issues(auctions: DataFrame, types: Sequence[str] = COUPON_TYPES, tenors: Sequence[str] = BREAKEVEN_TENORS) -> DataFrame:
    """cusip, tenor, first_auction_date of inflation-linked issues."""
    kept = auctions.where((F.col("inflation_index_security") == "Yes") & F.col("security_type").isin(*types) & F.col("original_security_term").isin(*tenors))
    return kept.groupBy("cusip", F.col("original_security_term").alias("tenor")).agg(F.min("auction_date").alias("first_auction_date"))


def headline(eod: DataFrame, auctions: DataFrame, types: Sequence[str] = COUPON_TYPES, tenors: Sequence[str] = HEADLINE_TENORS) -> DataFrame:
    """The five latest live issues of each day, tenor and asset class.

    An issue is live from its first auction day until the day before maturity. Equal auction dates go by cusip. The rank limit is
    pushed below the shuffle; issues are joined by cusip, by broadcast where the engine finds them small enough.
    """
    issues = first_auctions(auctions, types, tenors).withColumn("asset_class", asset_class(F.col("flag"))).drop("flag")
    live = eod.join(issues, "cusip").where((F.col("ts") >= F.col("first_auction_date")) & (F.col("ts") < F.col("maturity_date")))
    latest = Window.partitionBy("ts", "tenor", "asset_class").orderBy(F.col("first_auction_date").desc_nulls_last(), F.col("cusip"))
    ranked = live.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= RANKS)
    return ranked.select("ts", "tenor", "asset_class", "cusip", status_label(F.col("rank")).alias("status"), "px_last", "yld_ytm_mid")


def tips_nominal_pairs(tips: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each linker with the nominal that is current on its first auction day, exactly that day."""
    nominal = ranked.where((F.col("asset_class") == "nominal") & (F.col("status") == "c"))
    nominal = nominal.select(F.col("ts").alias("first_auction_date"), "tenor", F.col("cusip").alias("nominal_cusip"))
    return tips.join(nominal, ["first_auction_date", "tenor"]).select("tenor", F.col("cusip").alias("tips_cusip"), "nominal_cusip", "first_auction_date")


def breakeven(ranked: DataFrame, pairs: DataFrame, eod: DataFrame, statuses: Sequence[str] = ("c", "o", "oo")) -> DataFrame:
    """Nominal yield less linker yield; a missing nominal yield drops the row, a missing linker yield leaves it null.

    A linker meets its pairs by cusip alone and takes the pair's tenor, so one reopened under another term counts in both.
    """
    linkers = ranked.where((F.col("asset_class") == "tips") & F.col("status").isin(*statuses))
    linkers = linkers.select("ts", F.col("cusip").alias("tips_cusip"), "status", F.col("yld_ytm_mid").alias("tips_yield"))
    nominal = eod.where(F.col("yld_ytm_mid").isNotNull()).select("ts", F.col("cusip").alias("nominal_cusip"), F.col("yld_ytm_mid").alias("nominal_yield"))
    return (
        linkers.join(pairs.select("tips_cusip", "tenor", "nominal_cusip"), "tips_cusip")
        .join(nominal, ["nominal_cusip", "ts"])
        .select("ts", "tenor", "status", "nominal_cusip", "tips_cusip", "nominal_yield", "tips_yield", (F.col("nominal_yield") - F.col("tips_yield")).alias("breakeven"))
    )


def chart_long(frame: DataFrame, index: Sequence[str], series: Sequence[str]) -> DataFrame:
    """Chart data: one row per index and series."""
    return frame.unpivot(list(index), list(series), "series", "value")
