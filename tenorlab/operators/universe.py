"""Ticker universes as small generated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tenors and roots of the listed universes.
CURVE_TENORS = (2, 3, 5, 7, 10, 20, 30)
LINKER_TENORS = (5, 10, 30)
INDEXES = ("SPX", "NDX", "INDU")
SECTORS = ("XLC", "XLY", "XLP", "XLE", "XLF", "XLV", "XLI", "XLB", "XLRE", "XLK", "XLU")
METALS = ("XAU", "XAG", "XPT", "XPD")
FRONT_TWO = {"enrgy": ("CL", "CO", "NG", "XB", "HO"), "ag": ("C", "W", "S", "KC", "SB", "CT"), "ind_met": ("HG", "LA", "LX", "LN", "TIO")}
#: list -> (format of a tenor, tenors).
BY_TENOR = {
    "ust": ("USGG{}YR Index", CURVE_TENORS),
    "sofr_ois": ("USOSFR{} Curncy", (*CURVE_TENORS, 4)),
    "swp_spd": ("USSFCT{:02d} Curncy", CURVE_TENORS),
    "tips": ("USGGT{:02d}Y Index", LINKER_TENORS),
    "be": ("USGGBE{:02d}Y Index", LINKER_TENORS),
    "zc": ("USSWIT{} Curncy", (*CURVE_TENORS, 1, 4)),
}


def _tenors(spark: SparkSession, name: str) -> DataFrame:
    """The curve tenors; a list of fixed length, so joins of it are bounded."""
    return spark.createDataFrame([(t,) for t in CURVE_TENORS], f"{name} int")


def _leg(tenor: str) -> Column:
    return F.concat(F.col(tenor).cast("string"), F.when(F.col(tenor) < 10, "Y").otherwise(""))


def curve_pairs(spark: SparkSession) -> DataFrame:
    """a, b and the spread's ticker for every two tenors."""
    pairs = _tenors(spark, "a").join(F.broadcast(_tenors(spark, "b")), F.expr("a < b"))
    return pairs.select("a", "b", F.concat(F.lit("USYC"), _leg("a"), _leg("b"), F.lit(" Index")).alias("ticker"))


def fly_triples(spark: SparkSession) -> DataFrame:
    """a, b, c and the butterfly's ticker for every three tenors."""
    rows = _tenors(spark, "a").join(F.broadcast(_tenors(spark, "b")), F.expr("a < b")).join(F.broadcast(_tenors(spark, "c")), F.expr("b < c"))
    return rows.select("a", "b", "c", F.format_string("BF%02d%02d%02d Index", "a", "b", "c").alias("ticker"))


def universe(spark: SparkSession) -> DataFrame:
    """list, ticker: the listed single-name universes."""
    rows = [(name, form.format(t)) for name, (form, tenors) in BY_TENOR.items() for t in tenors]
    rows += [("stonk", f"{x} Index") for x in INDEXES] + [("sector", f"{x} US Equity") for x in SECTORS] + [("prec_met", f"{x} Curncy") for x in METALS]
    rows += [(name, f"{root}{n} Comdty") for name, roots in FRONT_TWO.items() for root in roots for n in (1, 2)]
    return spark.createDataFrame(rows, "list string, ticker string")
