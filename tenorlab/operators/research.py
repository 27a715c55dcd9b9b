"""Rolling out-of-sample trend and mean-reversion fits.

Frames are counted in rows, never in days. A window over a series is partitioned by the series' key, so series are fitted
in parallel; each row's fit is two regression aggregates over a frame of bounded length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenorlab.functions.scalars import half_life, long_run_mean, null_if_nan

LOOKBACK, OU_LOOKBACK, MIN_PAIRS, YEAR = 100, 300, 50, 252


def rolling_trend(series: DataFrame, value: str, key: str = "series", order: str = "ts", lookback: int = LOOKBACK) -> DataFrame:
    """Each row against the line through the ``lookback`` rows before it: fitted_oos, residual_oos, trend_slope, trend_intercept.

    Rows without a full window of values, or without a value, are left out. The intercept is that of the window's first row.
    """
    w = Window.partitionBy(key).orderBy(order)
    frame = w.rowsBetween(-lookback, -1)
    y, x = null_if_nan(F.col(value).cast("double")), F.col("__n").cast("double")
    numbered = series.withColumn("__n", F.row_number().over(w) - 1).withColumn("__y", y)
    fits = (
        numbered.withColumn("trend_slope", F.regr_slope("__y", x).over(frame))
        .withColumn("__i", F.regr_intercept("__y", x).over(frame))
        .withColumn("__c", F.count("__y").over(frame))
        .where((F.col("__c") == lookback) & F.col("__y").isNotNull())
    )
    return (
        fits.withColumn("fitted_oos", F.col("__i") + F.col("trend_slope") * F.col("__n"))
        .withColumn("residual_oos", F.col("__y") - F.col("fitted_oos"))
        .withColumn("trend_intercept", F.col("__i") + F.col("trend_slope") * (F.col("__n") - lookback))
        .drop("__n", "__y", "__i", "__c")
    )


def residual_diff(oos: DataFrame, key: str = "series", order: str = "ts") -> DataFrame:
    """Adds the first difference d_resid and the lagged residual."""
    w = Window.partitionBy(key).orderBy(order)
    return oos.withColumn("lag_resid", F.lag("residual_oos", 1).over(w)).withColumn("d_resid", F.col("residual_oos") - F.col("lag_resid"))


def ou_fit(oos: DataFrame, key: str = "series", order: str = "ts", lookback: int = OU_LOOKBACK) -> DataFrame:
    """theta, ou_mu, ou_half_life and ou_sigma from the ``lookback`` residuals before each row.

    The window's first residual has no predecessor in it, so ``lookback`` residuals give ``lookback`` - 1 pairs.
    """
    w = Window.partitionBy(key).orderBy(order)
    frame = w.rowsBetween(-(lookback - 1), -1)
    d = residual_diff(oos, key, order).withColumn("__k", F.row_number().over(w) - 1)
    fits = (
        d.withColumn("__s", F.regr_slope("d_resid", "lag_resid").over(frame))
        .withColumn("__i", F.regr_intercept("d_resid", "lag_resid").over(frame))
        .withColumn("__c", F.regr_count("d_resid", "lag_resid").over(frame))
        .withColumn("ou_sigma", F.stddev_samp("d_resid").over(frame))
        .where((F.col("__k") >= lookback) & (F.col("__c") >= MIN_PAIRS) & F.col("__s").isNotNull())
    )
    return (
        fits.withColumn("theta", -F.col("__s"))
        .withColumn("ou_mu", long_run_mean(F.col("__s"), F.col("__i")))
        .withColumn("ou_half_life", half_life(-F.col("__s")))
        .withColumnRenamed("__c", "n_pairs")
        .drop("__k", "__s", "__i")
    )


def plausible(fits: DataFrame, longest: float = YEAR) -> DataFrame:
    """Fits with a half-life strictly between 0 and ``longest``."""
    return fits.dropna(subset=["ou_half_life", "ou_sigma"]).where((F.col("ou_half_life") > 0) & (F.col("ou_half_life") < longest))


def describe(frame: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles (exact, interpolated) and max: one row per column, in one pass."""
    one = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
            F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(c).alias("max"),
        )
        for c in columns
    ]
    rows = frame.agg(F.array(*one).alias("r")).select(F.inline("r"))
    return rows.select("column", "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")
