"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def price_32nds(price: Column, is_ticks: bool = True, carry: bool = False) -> Column:
    """A decimal price as handle, 32nds and eighths of a 32nd, e.g. 112-20+; half eighths round to even.

    ``is_ticks`` is accepted and changes nothing. A fraction that rounds up to 32 prints as -32 unless ``carry``. Null and
    negative prices give null.
    """
    del is_ticks
    whole = F.floor(price).cast("long")
    eighths = F.bround((price - whole) * 256).cast("long")
    if carry:
        whole, eighths = whole + F.floor(eighths / 256).cast("long"), eighths % 256
    rest = eighths % 8
    suffix = F.when(rest == 0, "").when(rest == 4, "+").otherwise(rest.cast("string"))
    return F.when(price >= 0, F.format_string("%03d-%02d%s", whole, F.floor(eighths / 8).cast("long"), suffix))


def status_label(rank: Column) -> Column:
    """1 to 5 as c, o, oo, ooo, oooo; anything else is null."""
    return F.when(rank == 1, "c").when((rank > 1) & (rank <= 5), F.repeat(F.lit("o"), rank.cast("int") - 1))


def asset_class(flag: Column) -> Column:
    return F.when(flag == "Yes", "tips").otherwise("nominal")


def lenient_date(text: Column, form: str = "yyyy-MM-dd") -> Column:
    """A date, or null for text that is none."""
    return F.to_date(F.try_to_timestamp(text, F.lit(form)))


def any_date(value: Column) -> Column:
    """The day of a date, a time stamp or a text of either, compact or with dashes or slashes; null for what is none."""
    text = value.cast("string")
    forms = (F.lit("yyyy-MM-dd"), F.lit("yyyyMMdd"), F.lit("MM/dd/yyyy"), F.lit("yyyy/MM/dd"))
    return F.coalesce(text.try_cast("timestamp").cast("date"), *[F.to_date(F.try_to_timestamp(text, form)) for form in forms])


def lenient_double(text: Column) -> Column:
    return null_if_nan(text.try_cast("double"))


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def compact_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def utc_naive(stamp: Column, zone: str) -> Column:
    """A wall-clock time of ``zone`` as the wall-clock time of UTC."""
    return F.to_utc_timestamp(stamp, zone).cast("timestamp_ntz")


def assemble_timestamp(year: Column, month: Column, day: Column, hour=None, minute=None, second=None, millis=None) -> Column:
    """A timestamp from its parts; missing time parts count as zero."""
    part = lambda c: F.lit(0) if c is None else F.coalesce(c, F.lit(0))
    return F.make_timestamp(year, month, day, part(hour), part(minute), (part(second) + part(millis) / 1000).cast("decimal(8,6)"))


def first_token(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")[0]


def next_start(last_day: Column, today: Column) -> Column:
    """The day after ``last_day``, but not past ``today``."""
    return F.least(F.date_add(last_day, 1), today)


def half_life(theta: Column) -> Column:
    return F.when(theta > 0, F.lit(0.6931471805599453) / theta)


def long_run_mean(slope: Column, intercept: Column) -> Column:
    return F.when(slope != 0, -intercept / slope).otherwise(F.when(slope.isNotNull(), 0.0))


def typed(value: Column, datatype: str) -> Column:
    """Text as the feed's declared datatype; text that does not fit is null."""
    name = datatype.upper()
    if name.startswith("DATETIME"):
        return F.try_to_timestamp(value)
    for prefix, kind in (("FLOAT", "double"), ("INT", "bigint"), ("BOOL", "boolean")):
        if name.startswith(prefix):
            return value.try_cast(kind)
    return value.cast("string")


def column_name(name: str) -> str:
    """Trimmed, lower-case, spaces and camel humps as underscores."""
    out = ""
    for i, c in enumerate(name.strip()):
        if c.isupper() and i and (out and out[-1] not in "_ " and not name.strip()[i - 1].isupper()):
            out += "_"
        out += "_" if c == " " else c.lower()
    return out


def register_sql(spark: SparkSession) -> None:
    """The price format as a SQL function made of built-in expressions."""
    spark.sql(
        "create or replace temporary function price_32nds(p double) returns string return case when p >= 0 then "
        "format_string('%03d-%02d%s', cast(floor(p) as bigint), cast(floor(cast(bround((p - floor(p)) * 256) as bigint) / 8) as bigint), "
        "case cast(bround((p - floor(p)) * 256) as bigint) % 8 when 0 then '' when 4 then '+' else cast(cast(bround((p - floor(p)) * 256) as bigint) % 8 as string) end) end"
    )
