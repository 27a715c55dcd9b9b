"""Normalising landed records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType

from tenorlab.functions.scalars import column_name, lenient_date, lenient_double
from tenorlab.operators.dml import keep_last
from tenorlab.schemas import AUCTIONS

#: Fields of auction records, and those that are dates and numbers, by the stored table's types.
AUCTION_FIELDS = tuple(f.name for f in AUCTIONS if f.name != "ingest_seq")
DATES = tuple(f.name for f in AUCTIONS if isinstance(f.dataType, DateType))
NUMBERS = tuple(f.name for f in AUCTIONS if isinstance(f.dataType, DoubleType))
#: The same of securities from the treasury's own feed.
SECURITY_DATES = ("issue_date", "auction_date", "announcement_date", "maturity_date", "dated_date")
SECURITY_NUMBERS = ("interest_rate", "refcpi_on_issue_date")


def normalize_names(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[column_name(c) for c in rows.columns])


def coerce(rows: DataFrame, dates: Sequence[str] = DATES, numbers: Sequence[str] = NUMBERS) -> DataFrame:
    """Date and number columns parsed leniently; text that is neither becomes null."""
    parse = {c: lenient_date(F.col(c)) for c in dates if c in rows.columns} | {c: lenient_double(F.col(c)) for c in numbers if c in rows.columns}
    return rows.withColumns(parse)


def auctions_from_records(rows: DataFrame, ingest_seq: str = "ingest_seq") -> DataFrame:
    """Records normalised, coerced and de-duplicated: the last of each (cusip, auction_date), or of each cusip without dates."""
    return _last_of_each(coerce(normalize_names(rows)), "auction_date", ingest_seq)


def securities_from_records(rows: DataFrame, ingest_seq: str = "ingest_seq") -> DataFrame:
    """Securities of the treasury's own feed: the last of each (cusip, issue_date), or of each cusip without dates."""
    named = rows.toDF(*[plain_name(c) for c in rows.columns])
    return _last_of_each(coerce(named, SECURITY_DATES, SECURITY_NUMBERS), "issue_date", ingest_seq)


def plain_name(name: str) -> str:
    """A column name trimmed, in lower case, with underscores for spaces."""
    return name.strip().lower().replace(" ", "_")


def _last_of_each(clean: DataFrame, day: str, ingest_seq: str) -> DataFrame:
    return keep_last(clean, [c for c in ("cusip", day) if c in clean.columns], [ingest_seq])


def rename(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return rows.withColumnsRenamed(dict(names))
