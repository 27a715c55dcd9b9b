import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tenorlab.functions.scalars import assemble_timestamp, column_name, price_32nds, register_sql, status_label, utc_naive
from tenorlab.operators import connector, live, universe
from tenorlab.operators.bars import fill_gaps, intraday_bars, resample
from tenorlab.sources.paging import PagedRecords, with_retry
from tenorlab.session import shared_path
from tenorlab.streaming.feeds import LiveFeed, StatusListener, file_stream, live_last_values, run_available, stamped, subscribed

PRICES = {112.640625: "112-20+", 112.625: "112-20", 112.65625: "112-21", 112.6484375: "112-206", 99.5: "099-16", 112.6328125: "112-202", 101.00390625: "101-001", 99.999: "099-32"}


def test_prices(spark):
    register_sql(spark)
    rows = spark.createDataFrame([(p,) for p in [*PRICES, -1.0, None]], "p double")
    got = rows.select("p", price_32nds(F.col("p")).alias("s"), F.expr("price_32nds(p)").alias("q"), price_32nds(F.col("p"), carry=True).alias("c")).collect()
    assert {r.p: r.s for r in got if r.p in PRICES} == PRICES and all(r.s == r.q for r in got)
    assert {r.c for r in got if r.p == 99.999} == {"100-00"} and all(r.s is None for r in got if r.p is None or r.p < 0)


def test_small_scalars(spark):
    assert [column_name(x) for x in (" Issue Date", "auctionDate", "CUSIP", "refCpiOnIssueDate")] == ["issue_date", "auction_date", "cusip", "ref_cpi_on_issue_date"]
    r = spark.range(1).select(
        *[status_label(F.lit(k)).alias(f"s{k}") for k in range(7)], utc_naive(F.lit("2024-07-01 12:00:00").cast("timestamp"), "America/New_York").alias("u"),
        assemble_timestamp(F.lit(2024), F.lit(1), F.lit(2)).alias("t"),
    ).first()
    assert [r[f"s{k}"] for k in range(7)] == [None, "c", "o", "oo", "ooo", "oooo", None]
    assert r.u == dt.datetime(2024, 7, 1, 16) and r.t == dt.datetime(2024, 1, 2)


def test_universe_counts(spark):
    n = {r["list"]: r["count"] for r in universe.universe(spark).groupBy("list").count().collect()}
    assert n == {"ust": 7, "sofr_ois": 8, "swp_spd": 7, "tips": 3, "be": 3, "zc": 9, "stonk": 3, "sector": 11, "prec_met": 4, "enrgy": 10, "ag": 12, "ind_met": 10}
    assert universe.curve_pairs(spark).count() == 21 and universe.fly_triples(spark).count() == 35


UPDATES = "security string, event_ts timestamp, seq long, LAST_PRICE double, BID double, ASK double, BID_SIZE long, ASK_SIZE long"


def updates(spark):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("S1", t, 1, None, 1.0, None, None, None), ("S1", t, 2, None, None, 2.0, None, None), ("S1", t, 3, None, 3.0, None, None, None), ("S2", t, 4, 9.0, None, None, None, None)], UPDATES)


def test_last_values_and_lines(spark):
    cache = live.last_values(updates(spark))
    assert {r.security: (r.LAST_PRICE, r.BID, r.ASK) for r in cache.collect()} == {"S1": (None, 3.0, 2.0), "S2": (9.0, None, None)}
    flags = spark.createDataFrame([("S1", True)], "security string, use_ticks boolean")
    lines = {r.security: (r.use_ticks, r.line) for r in live.quote_lines(cache, flags).collect()}
    assert lines == {"S1": (True, "2024-01-01 00:00:00 | S1 | Bid: 003-00 | Ask: 002-00"), "S2": (False, "2024-01-01 00:00:00 | S2 | Last: 009-00")}


def test_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate(updates(spark).randomSplit([0.5, 0.5], 3)):
        part.write.parquet(f"file://{tmp_path}/in/{i}")
    stream = file_stream(spark, f"file://{tmp_path}/in", updates(spark).schema, files_per_trigger=1)
    got = run_available(live_last_values(stream), ["security"])
    key = lambda r: r.security
    assert sorted(got.collect(), key=key) == sorted(live.last_values(updates(spark)).select(*got.columns).collect(), key=key)


def test_bars_and_gaps(spark):
    at = lambda m, s=0: dt.datetime(2024, 1, 1, 9, m, s)
    ticks = spark.createDataFrame([("A", at(0), 1.0, 5), ("A", at(1), 3.0, 5), ("A", at(4, 59), 2.0, None), ("A", at(16), 7.0, 1)], "security string, time timestamp, value double, size long")
    rows = fill_gaps(intraday_bars(ticks)).orderBy("time").collect()
    assert [(r.time.minute, r.open, r.high, r.low, r.close, r.volume, r.numEvents) for r in rows] == [(0, 1, 3, 1, 2, 10, 3), (5, 2, 2, 2, 2, 0, 0), (10, 2, 2, 2, 2, 0, 0), (15, 7, 7, 7, 7, 1, 1)]


def test_connector_requests(spark):
    ref = spark.createDataFrame([("A", 1.0, [(1, "x")]), ("B", 2.0, [])], "security string, PX double, holders array<struct<n:int,name:string>>")
    assert {tuple(r) for r in connector.bulk(ref, "holders").collect()} == {("A", 1, "x"), ("B", None, None)}
    got = connector.snapshot(ref, ["A"], ["PX", "NOPE"]).first()
    assert got.asDict() == {"security": "A", "PX": 1.0, "NOPE": None, "error": "unknown field: NOPE"}
    empty = connector.snapshot(ref, [], ["PX"])
    assert empty.count() == 0 and empty.columns == ["security", "PX", "error"]
    days = spark.createDataFrame([("A", dt.date(2024, 1, 5), 1.0), ("A", dt.date(2024, 1, 31), None), ("A", dt.date(2024, 2, 1), 3.0)], "security string, date date, PX double")
    assert [(str(r.period), r.PX) for r in resample(days, ["PX"], "MONTHLY").orderBy("period").collect()] == [("2024-01-01", 1.0), ("2024-02-01", 3.0)]


def test_paged_source_filters_and_numbers(spark, tmp_path):
    files = []
    for i in range(2):
        files.append(str(tmp_path / f"{i}.json"))
        (tmp_path / f"{i}.json").write_text(json.dumps({"data": [{"cusip": f"C{i}", "auction_date": f"2024-0{i + 1}-01"}], "links": {}}))
    spark.dataSource.register(PagedRecords)
    read = spark.read.format("paged_records").option("files", json.dumps(files))
    assert sorted(tuple(r) for r in read.load().collect()) == [("C0", "2024-01-01", 0), ("C1", "2024-02-01", 10_000)]
    assert [r.cusip for r in read.option("after", "2024-01-15").load().collect()] == ["C1"]


def test_retry_backs_off():
    waits, calls = [], []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "ok"

    assert with_retry(fetch, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        with_retry(lambda: (_ for _ in ()).throw(OSError()), retries=2, sleep=waits.append)


def test_status_listener():
    seen = []
    StatusListener(lambda kind, e: seen.append(kind)).onQueryStarted(None)
    assert seen == ["started"]


def test_feeds_take_what_is_subscribed(spark):
    got = subscribed(updates(spark), {"S1": ["BID"], "S3": ["ASK"]}).collect()
    assert [(r.security, r.BID, r.ASK) for r in sorted(got, key=lambda r: r.seq)] == [("S1", 1.0, None), ("S1", None, None), ("S1", 3.0, None)]
    assert all(r.arrival_ts is not None for r in stamped(updates(spark)).collect())


def test_a_feed_starts_and_stops_once(spark, tmp_path):
    import time

    updates(spark).write.parquet(f"file://{tmp_path}/in/0")
    stream = stamped(file_stream(spark, f"file://{tmp_path}/in", updates(spark).schema))
    shown, said = [], []
    feed = LiveFeed(live_last_values(stream), lambda rows, n: shown.append({r.security: r.BID for r in rows.collect()}), "1 second", lambda kind, _: said.append(kind))
    with feed:
        assert feed.start() is feed and feed.running and len(spark.streams.active) == 1
        for i in range(200):
            if shown:
                break
            if i == 100:
                updates(spark).write.parquet(f"file://{tmp_path}/in/1")
            time.sleep(0.1)
    feed.stop()
    assert not feed.running and shown[0] == {"S1": 3.0, "S2": None} and "started" in said


def test_a_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(Session, "x")
