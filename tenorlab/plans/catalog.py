"""The reference queries by name. Each runs over whole tables and has its SQL in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlab.functions.scalars import compact_date, first_token, half_life, iso_date, lenient_date, lenient_double, next_start, price_32nds, typed
from tenorlab.operators import connector, curves, dml, ingest, live, research, universe
from tenorlab.operators.bars import fill_gaps, intraday_bars, intraday_ticks, resample
from tenorlab.plans import adapter as A
from tenorlab.plans.oracles import ORACLES  # noqa: F401
from tenorlab.session import shared_path
from tenorlab.sources.readers import json_records, table
from tenorlab.streaming.feeds import file_stream, live_bars, live_last_values, run_available

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SPLIT_DAY = "1999-01-01"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# --- issues, ranks, breakevens -----------------------------------------------------------------


@query
def first_auction(spark, sf):
    return curves.first_auctions(A.auctions(spark, sf), A.TYPES, A.TENORS)


@query
def tips_first_issue(spark, sf):
    return curves.tips_first_issues(A.auctions(spark, sf), A.TYPES, A.LINKER_TENORS)


@query
def eod_panel(spark, sf):
    return rounded(A.eod(spark, sf), px_last=9, yld_ytm_mid=6)


def _headline(spark, sf):
    return curves.headline(A.eod(spark, sf), A.auctions(spark, sf), A.TYPES, A.TENORS)


@query
def headline_rank(spark, sf):
    return rounded(_headline(spark, sf), px_last=9, yld_ytm_mid=6)


@query
def headline_current(spark, sf):
    return headline_rank(spark, sf).where(F.col("status") == "c").select("ts", "tenor", "asset_class", "cusip", "px_last")


@query
def headline_status_counts(spark, sf):
    return _headline(spark, sf).groupBy("asset_class", "status").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _split_build(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A build up to SPLIT_DAY, then an incremental run: the rows that the second run appends."""
    sink = rows.where(F.col("ts") <= F.lit(SPLIT_DAY).cast("date"))
    return dml.incremental(rows, sink).select(*keys)


@query
def headline_incremental(spark, sf):
    return _split_build(_headline(spark, sf), ["ts", "tenor", "asset_class", "status", "cusip"])


def _pairs(spark, sf):
    return curves.tips_nominal_pairs(curves.tips_first_issues(A.auctions(spark, sf), A.TYPES, A.LINKER_TENORS), _headline(spark, sf))


@query
def tips_nominal_pairs(spark, sf):
    return _pairs(spark, sf)


def _breakeven(spark, sf):
    return curves.breakeven(_headline(spark, sf), _pairs(spark, sf), A.eod(spark, sf))


@query
def breakeven(spark, sf):
    return rounded(_breakeven(spark, sf), nominal_yield=6, tips_yield=6, breakeven=6)


@query
def breakeven_incremental(spark, sf):
    return _split_build(_breakeven(spark, sf), ["ts", "tenor", "status", "nominal_cusip", "tips_cusip"])


@query
def chart_long(spark, sf):
    return curves.chart_long(breakeven(spark, sf), ["ts", "tenor", "status"], ["nominal_yield", "tips_yield", "breakeven"])


# --- rolling research --------------------------------------------------------------------------


def _oos(spark, sf):
    return research.rolling_trend(A.order_series(spark, sf), "value")


def _ou(spark, sf):
    return research.ou_fit(_oos(spark, sf))


@query
def rolling_trend_oos(spark, sf):
    return rounded(_oos(spark, sf).select("ts", "fitted_oos", "residual_oos"), fitted_oos=2, residual_oos=2)


@query
def trend_params(spark, sf):
    return rounded(_oos(spark, sf).select("ts", "trend_slope", "trend_intercept"), trend_slope=4, trend_intercept=2)


@query
def residual_diff(spark, sf):
    return rounded(research.residual_diff(_oos(spark, sf)).select("ts", "lag_resid", "d_resid"), lag_resid=2, d_resid=2)


OU = {"theta": 5, "ou_mu": 2, "ou_half_life": 5, "ou_sigma": 3}


@query
def ou_params(spark, sf):
    return rounded(_ou(spark, sf).select("ts", "n_pairs", *OU), **OU)


@query
def ou_halflife_filtered(spark, sf):
    return rounded(research.plausible(_ou(spark, sf)).select("ts", "ou_half_life", "ou_sigma"), ou_half_life=5, ou_sigma=3)


@query
def ou_describe(spark, sf):
    out = research.describe(research.plausible(_ou(spark, sf)), ["theta", "ou_half_life"])
    return rounded(out, mean=5, std=5, min=5, q25=5, q50=5, q75=5, max=5)


@query
def series_filtered_ordered(spark, sf):
    rows = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    return rows.select(F.to_date("o_orderdate").alias("ts"), "o_orderkey", F.round("o_totalprice", 2).alias("price")).orderBy("ts", "o_orderkey")


# --- ingest and loads --------------------------------------------------------------------------


@query
def distinct_ids(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_partkey").isNotNull()).select(F.col("l_partkey").cast("string").alias("cusip")).distinct().orderBy("cusip")


@query
def hwm_minmax(spark, sf):
    rows = table(spark, sf, "lineitem").agg(F.min(F.to_date("l_shipdate")).alias("first_day"), F.max(F.to_date("l_shipdate")).alias("last_day"), F.count(F.lit(1)).alias("n"))
    today = F.lit("2001-06-30").cast("date")
    return rows.withColumn("next_start", next_start(F.col("last_day"), today)).withColumn("clamped", next_start(F.col("last_day"), today) == today)


KEYS, ORDER = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
_LINE = [*KEYS, "l_partkey", "l_quantity", "l_discount", "l_shipdate"]


def _lines(spark, sf, part: int | None = None) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    if part is not None:
        rows = rows.where((F.col("l_returnflag") == "R") == F.lit(bool(part)))
    return dml.keep_last(rows, KEYS, ORDER).select(*[F.to_date(c).alias(c) if c == "l_shipdate" else F.col(c) for c in _LINE])


@query
def dedupe_keep_last(spark, sf):
    return _lines(spark, sf)


@query
def insert_ignore(spark, sf):
    return dml.insert_ignore(_lines(spark, sf, 0), _lines(spark, sf, 1), KEYS)


@query
def upsert_merge(spark, sf):
    old = _lines(spark, sf, 0).withColumn("created_at", F.lit("t0"))
    return dml.upsert(old, _lines(spark, sf, 1).withColumn("created_at", F.lit("t1")), KEYS)


@query
def full_refresh(spark, sf):
    rows = A.eod(spark, sf).select("ts", "cusip", F.round("px_last", 9).alias("px_last"))
    return dml.full_refresh(dml.with_year(rows), shared_path(spark, "refresh"), ["year"]).select("ts", "cusip", "px_last", F.col("year").cast("int").alias("year"))


@query
def schema_align_union(spark, sf):
    c = ingest.rename(table(spark, sf, "customer"), {"c_custkey": "key", "c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"})
    s = ingest.rename(table(spark, sf, "supplier"), {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"})
    like = c.withColumn("source", F.lit("customer"))
    return like.unionByName(dml.align(s.withColumn("source", F.lit("supplier")), like))


@query
def normalize_columns(spark, sf):
    messy = table(spark, sf, "part").toDF("P Partkey", " pName", "P BRAND", "pType ", "P Size", "pRetailPrice")
    return ingest.normalize_names(messy)


@query
def schema_probe(spark, sf):
    probe = table(spark, sf, "lineitem").limit(0)
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(probe.schema)], "position int, column_name string, data_type string")


@query
def lenient_parse(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("19"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("-02-"), F.lpad((F.col("p_size") % 31 + 1).cast("string"), 2, "0")))
        .when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("").alias("day"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise(F.col("p_name")).alias("number"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name")).alias("size"))
    return rows.select("p_partkey", lenient_date(F.col("day")).alias("day"), lenient_double(F.col("number")).alias("number"), typed(F.col("size"), "INTEGER64").alias("whole"))


@query
def json_extract(spark, sf):
    rows = json_records(table(spark, sf, "events").select("event_id", "props"), "props", "k bigint")
    return rows.select("event_id", F.col("props.k").alias("k"))


@query
def explode_bulk(spark, sf):
    item = F.struct("l_linenumber", "l_partkey", "l_quantity")
    nested = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("security")).agg(F.collect_list(item).alias("items"))
    every = table(spark, sf, "orders").select(F.col("o_orderkey").alias("security")).join(nested, "security", "left")
    return connector.bulk(every, "items")


# --- connector-shaped requests -----------------------------------------------------------------


@query
def snapshot_fields(spark, sf):
    ref = table(spark, sf, "customer").withColumnRenamed("c_name", "security").withColumn("error", F.when(F.col("c_acctbal") < 0, "no data"))
    picked = [f"Customer#{i:09d}" for i in range(0, 140, 2)]
    got = connector.snapshot(ref, picked, ["c_acctbal", "c_mktsegment", "currency"], {"currency": "USD"})
    return connector.without_errors(got)


def _order_history(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("security"), F.to_date("o_orderdate").alias("date"))
    return rows.agg(F.max("o_totalprice").alias("px_last"), F.min("o_totalprice").alias("px_low"))


@query
def history_range(spark, sf):
    import datetime as dt

    rows = connector.history(_order_history(spark, sf), ["1-URGENT", "5-LOW"], ["px_last", "px_low"], dt.date(1996, 3, 1), dt.date(1998, 6, 30))
    fields = F.map_from_arrays(F.array(F.lit("px_last"), F.lit("px_low")), F.array("px_last", "px_low"))
    rows = connector.touched(rows.withColumn("payload", fields), ["px_last", "bid"])
    return rows.select("security", compact_date(F.col("date")).alias("day"), iso_date(F.col("date")).alias("iso_day"), "px_last", "px_low").orderBy("security", "day")


@query
def periodic_resample(spark, sf):
    return resample(_order_history(spark, sf), ["px_last", "px_low"], "MONTHLY")


ORDERED = ("time", "seq")


@query
def intraday_bars_5m(spark, sf):
    return intraday_bars(A.ticks(table(spark, sf, "events")), 5, ORDERED).withColumn("time", F.col("time").cast("timestamp_ntz"))


QUERIES["intraday_bars"] = QUERIES.pop("intraday_bars_5m")


@query
def bars_gap_filled(spark, sf):
    bars = fill_gaps(intraday_bars(A.ticks(table(spark, sf, "events")), 60, ORDERED), 60)
    return bars.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def ticks_filtered(spark, sf):
    rows = A.ticks(table(spark, sf, "events"))
    at = lambda day: F.make_timestamp(F.lit(2024), F.lit(1), F.lit(day), F.lit(0), F.lit(0), F.lit(0))
    got = intraday_ticks(rows.where(F.col("time") >= at(5)).where(F.col("time") < at(20)), "click", "2024-01-05", "2024-01-20", ("TRADE",), True)
    return got.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def instrument_search(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("security"), F.col("p_name").alias("description"), F.col("p_type").alias("yellowKey"))
    return connector.security_search(rows, "RING", 50)


@query
def field_info(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.format_string("F%03d", "n_nationkey").alias("id"), F.col("n_name").alias("mnemonic"), F.concat(F.lit("field of "), F.col("r_name")).alias("description"), F.col("r_name").alias("categoryName"))
    return connector.field_info(rows, ["NATION_3", "NATION_7", "F011", "NATION_99"])


@query
def topk_latest(spark, sf):
    rows = table(spark, sf, "orders").where((F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") == "2-HIGH"))
    rows = rows.select("o_orderkey", F.to_date("o_orderdate").alias("auction_date"), "o_totalprice")
    return rows.orderBy(F.col("auction_date").desc_nulls_first(), F.col("o_orderkey")).limit(40)


@query
def tail_n(spark, sf):
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return days.orderBy(F.col("ts").desc()).limit(10).orderBy("ts")


# --- scalars and universes ---------------------------------------------------------------------


@query
def price_32nds_format(spark, sf):
    p = F.col("p_retailprice") / 10
    return table(spark, sf, "part").select("p_partkey", price_32nds(p).alias("price"), price_32nds(p, carry=True).alias("carried"), F.round(half_life(F.col("p_size") / 100 - 0.1), 6).alias("half_life"))


QUERIES["price_32nds"] = QUERIES.pop("price_32nds_format")


@query
def curve_pairs(spark, sf):
    return universe.curve_pairs(spark)


@query
def fly_triples(spark, sf):
    return universe.fly_triples(spark)


@query
def ticker_universe(spark, sf):
    return universe.universe(spark).withColumn("root", first_token(F.col("ticker")))


# --- live state --------------------------------------------------------------------------------


def _cache_out(cache: DataFrame) -> DataFrame:
    return cache.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query
def last_value_cache(spark, sf):
    return _cache_out(live.last_values(A.updates(table(spark, sf, "events"))))


@query
def quote_line(spark, sf):
    return live.quote_lines(live.last_values(A.updates(table(spark, sf, "events"))), A.flags(spark))


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return file_stream(spark, sf, schema, "events.parquet")


@query
def stream_last_value(spark, sf):
    return _cache_out(run_available(live_last_values(A.updates(_event_stream(spark, sf))), ["security"]))


@query
def stream_bars(spark, sf):
    rows = run_available(live_bars(A.ticks(_event_stream(spark, sf)), 60, "30 days", ORDERED), ["security", "time"])
    return rows.withColumn("time", F.col("time").cast("timestamp_ntz"))
