"""Builds of the stored tables, as a command: python -m tenorlab.jobs headline --store FOLDER [--rebuild]."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tenorlab.operators import curves, dml, ingest
from tenorlab.schemas import BREAKEVEN, HEADLINE, KEYS
from tenorlab.session import build_session, exists
from tenorlab.sources.paging import paged_records
from tenorlab.sources.readers import table


def stored(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """A stored table, or None where it is not there yet."""
    return table(spark, store, name) if exists(spark, f"{store}/{name}.parquet") else None


def _source(spark: SparkSession, store: str, name: str) -> DataFrame:
    found = stored(spark, store, name)
    if found is None:
        raise FileNotFoundError(f"{store} holds no table {name}")
    return found


def headline(spark: SparkSession, store: str) -> DataFrame:
    return curves.headline(_source(spark, store, "ust_eod"), _source(spark, store, "auctions"))


def breakeven(spark: SparkSession, store: str) -> DataFrame:
    ranked = _source(spark, store, "headline")
    return curves.breakeven(ranked, curves.tips_nominal_pairs(curves.tips_first_issues(_source(spark, store, "auctions")), ranked), _source(spark, store, "ust_eod"))


#: The stored tables' schemas, and words that ask for a build anew.
TABLES = {"headline": HEADLINE, "breakeven": BREAKEVEN}
FULL = ("full", "all", "refresh")
BUILDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"headline": headline, "breakeven": breakeven}


def build(spark: SparkSession, store: str, name: str, rebuild: bool = False) -> tuple[str, int]:
    """Build a table in its store, made first where it is not there: what was done ('full', 'append' or 'nothing') and how many rows went in."""
    path = f"{store}/{name}.parquet"
    dml.ensure_table(spark, path, TABLES[name])
    sink = stored(spark, store, name)
    done, rows = dml.build(lambda: dml.align(BUILDS[name](spark, store), sink), sink, "full" if rebuild else "incremental")
    if rows is None:
        return done, 0
    dml.assert_unique(rows, KEYS[name])
    return done, dml.written(rows, (lambda r: dml.full_refresh(r, path)) if done == "full" else (lambda r: dml.append(r, path)))


def pull_auctions(spark: SparkSession, store: str, rebuild: bool = False, **options: str) -> tuple[str, int]:
    """Load auction records from a paged source: all of them, or those after the stored ones' last day, known keys ignored."""
    sink = None if rebuild else stored(spark, store, "auctions")
    mark = dml.high_water_mark(sink, "auction_date")
    columns = ", ".join(f"{c} string" for c in ingest.AUCTION_FIELDS) + ", ingest_seq long"
    asked = options if mark is None else options | {"after": mark.isoformat()}
    rows = ingest.auctions_from_records(paged_records(spark, columns, **asked))
    path = f"{store}/auctions.parquet"
    if mark is None:
        return "full", dml.written(rows, lambda r: dml.full_refresh(r, path))
    fresh = dml.insert_ignore(sink, rows, ["cusip", "auction_date"], ["ingest_seq"])
    return "append", dml.written(fresh, lambda r: dml.append(r, path))


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Build a stored table")
    parser.add_argument("table", choices=[*BUILDS, "auctions"])
    parser.add_argument("mode", nargs="?", choices=["incremental", *FULL], default="incremental", help="how to build; full, all and refresh mean --rebuild")
    parser.add_argument("--store", required=True, help="folder of the stored tables")
    parser.add_argument("--rebuild", action="store_true", help="build it anew instead of adding what is new")
    parser.add_argument("--url", help="auctions: address of the paged API")
    parser.add_argument("--files", help="auctions: landed pages as a JSON list of files")
    asked = parser.parse_args(arguments)
    rebuild = asked.rebuild or asked.mode in FULL
    spark = build_session()
    if asked.table == "auctions":
        options = {k: v for k, v in (("url", asked.url), ("files", asked.files)) if v}
        if not options:
            parser.error("auctions need --url or --files")
        done, n = pull_auctions(spark, asked.store, rebuild, **options)
    else:
        done, n = build(spark, asked.store, asked.table, rebuild)
    print(f"{asked.table}: {'up to date' if done == 'nothing' else f'{n:,} rows, {done}'}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
