"""Connector-shaped requests over stored tables: snapshot, bulk field, history, search, field metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenorlab.operators.bars import resample


def snapshot(reference: DataFrame, securities: Sequence[str], fields: Sequence[str], overrides: Mapping[str, object] | None = None) -> DataFrame:
    """One row per security: the fields, overridden ones by their given value, and ``error`` last."""
    kept = reference.where(F.col("security").isin(*securities))
    value = lambda f: (F.lit(overrides[f]) if overrides and f in overrides else F.col(f) if f in kept.columns else F.lit(None).cast("string")).alias(f)
    missing = [f for f in fields if f not in kept.columns and f not in (overrides or {})]
    error = F.lit(f"unknown field: {', '.join(missing)}" if missing else None).cast("string")
    if "error" in kept.columns:
        error = F.coalesce("error", error)
    return kept.select("security", *[value(f) for f in fields], error.alias("error"))


def without_errors(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull()).drop("error")


def bulk(reference: DataFrame, field: str) -> DataFrame:
    """A table-valued field as rows; a security without any keeps one row of nulls."""
    return reference.select("security", F.explode_outer(field).alias("e")).select("security", "e.*")


def history(table: DataFrame, securities: Sequence[str], fields: Sequence[str], start, end, periodicity: str = "DAILY") -> DataFrame:
    """security, date and fields over [start, end], both ends included."""
    kept = table.where(F.col("security").isin(*securities) & F.col("date").between(F.lit(start), F.lit(end))).select("security", "date", *fields)
    return kept if periodicity == "DAILY" else resample(kept, fields, periodicity).withColumnRenamed("period", "date")


def security_search(instruments: DataFrame, text: str, max_results: int = 50) -> DataFrame:
    """The first instruments by name whose description holds the text, whatever its case."""
    return instruments.where(F.lower("description").contains(text.lower())).orderBy("description", "security").limit(max_results)


def field_info(catalogue: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Metadata of fields by mnemonic or id."""
    return catalogue.where(F.col("mnemonic").isin(*fields) | F.col("id").isin(*fields))


def touched(updates: DataFrame, names: Sequence[str], payload: str = "payload") -> DataFrame:
    """Updates whose payload holds at least one of the named fields."""
    return updates.where(F.arrays_overlap(F.map_keys(payload), F.array(*map(F.lit, names))))
