import http.server
import json
import threading
import time
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tenorlab.functions.scalars import any_date
from tenorlab.sources.paging import PUSHDOWN, PagedRecords, landed, one_shot, paged_records
from tenorlab.sources.readers import landed_pages, list_columns, relation, table
from tenorlab.sources.vendor import Event, VendorSession

RECORDS = [{"cusip": f"C{i}", "auction_date": f"2024-01-{i + 1:02d}"} for i in range(25)]


class Api(http.server.BaseHTTPRequestHandler):
    """Pages of RECORDS; the second request fails once."""

    asked: list = []
    failures = [1]

    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        self.asked.append(q)
        if len(self.asked) == 2 and self.failures:
            self.failures.pop()
            self.send_error(500)
            return
        rows = RECORDS
        for column, how, value in (x.split(":") for x in q["filter"].split(",")) if "filter" in q else ():
            rows = [r for r in rows if {"gt": r[column] > value, "gte": r[column] >= value, "lt": r[column] < value, "lte": r[column] <= value, "eq": r[column] == value}[how]]
        size, number = int(q["page[size]"]), int(q["page[number]"])
        part = rows[(number - 1) * size : number * size]
        body = json.dumps({"data": part, "links": {"next": "x" if number * size < len(rows) else None}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def api():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Api.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/auctions"
    server.shutdown()


def test_pages_are_followed_and_filters_pushed(spark, api):
    spark.conf.set(PUSHDOWN, "true")
    try:
        read = lambda **more: paged_records(spark, url=api, page_rows="10", **more)
        got = sorted(read().collect(), key=lambda r: r.ingest_seq)
        assert [(r.cusip, r.ingest_seq) for r in got] == [(f"C{i}", i) for i in range(25)]
        assert [q["page[number]"] for q in Api.asked] == ["1", "2", "2", "3"]  # one failed and was asked again
        Api.asked.clear()
        late = read().where((F.col("auction_date") > "2024-01-20") & (F.col("cusip") != "C24") & (F.col("auction_date") <= "2024-01-25"))
        assert sorted(r.cusip for r in late.collect()) == ["C20", "C21", "C22", "C23"]
        assert {tuple(sorted(q["filter"].split(","))) for q in Api.asked} == {("auction_date:gt:2024-01-20", "auction_date:lte:2024-01-25")}
        assert read(after="2024-01-24").count() == 1
    finally:
        spark.conf.unset(PUSHDOWN)


def test_landed_files_are_followed_until_the_last(spark, tmp_path):
    files = []
    for i, more in enumerate((True, False, True)):
        files.append(str(tmp_path / f"{i}.json"))
        (tmp_path / f"{i}.json").write_text(json.dumps({"data": [{"cusip": f"C{i}", "auction_date": None}], "links": {"next": "x" if more else None}}))
    spark.dataSource.register(PagedRecords)
    read = spark.read.format("paged_records").option("files", json.dumps(files))
    assert read.load().count() == 3 and read.option("follow", "true").load().count() == 2
    with pytest.raises(Exception, match="more than the page size"):
        read.option("page_rows", 0).load().collect()
    assert {tuple(r)[1:] for r in landed_pages(spark, f"file://{tmp_path}/*.json", ["cusip", "other"]).collect()} == {(0, f"C{i}", None) for i in range(3)}


def test_relations_are_known_to_sql(spark, sf):
    relation(table(spark, sf, "nation"), "own_nations")
    assert spark.sql("select count(*) n from own_nations").first().n == 25 and "n_name" in list_columns(spark, "own_nations")


class Backend:
    def __init__(self, events=(), up=True):
        self.events, self.up, self.sent = list(events), up, []

    def start(self):
        return self.up

    def open(self, service):
        return service == "ref"

    def operations(self, service):
        return ["HistoricalDataRequest", "instrumentListRequest"]

    def send(self, service, operation, fields, number):
        self.sent.append((operation, dict(fields), number))

    def next_event(self, seconds):
        time.sleep(min(seconds, 0.01))
        return self.events.pop(0) if self.events else None


def test_vendor_sessions_answer_and_fail_in_words():
    backend = Backend([Event("other"), Event("partial", ((0, {"a": 1}), (9, {"x": 0}))), Event("response", ((9, {"x": 1}),)), Event("response", ((0, {"a": 2}),))])
    session = VendorSession(backend)
    assert session.ask("ref", "HistoricalDataRequest", security="A") == [{"a": 1}, {"a": 2}]
    backend.events = [Event("response", ((1, {"b": 1}),))]
    assert session.ask("ref", "InstrumentListRequest") == [{"b": 1}]
    assert backend.sent == [("HistoricalDataRequest", {"security": "A"}, 0), ("instrumentListRequest", {}, 1)]
    with pytest.raises(RuntimeError, match="service other cannot be opened"):
        session.ask("other", "HistoricalDataRequest")
    with pytest.raises(RuntimeError, match="no operation Nope; it has HistoricalDataRequest"):
        session.ask("ref", "Nope")
    with pytest.raises(RuntimeError, match="cannot start"):
        VendorSession(Backend(up=False)).ask("ref", "HistoricalDataRequest")
    with pytest.raises(TimeoutError):
        VendorSession(Backend(), event_s=0.005).ask("ref", "HistoricalDataRequest")


def test_one_answer_is_read_whatever_type_it_names(spark):
    answers = [("text/html", b"<html>busy</html>"), ("text/plain", b'[{"cusip": "C1", "x": 1.5}, {"cusip": "C2", "y": null}]')]

    class Once(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            kind, body = answers.pop(0) if len(answers) > 1 else answers[0]
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Once)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    waits = []
    try:
        records = one_shot(f"http://127.0.0.1:{server.server_port}/", sleep=waits.append)
        assert waits == [1.0] and [tuple(r) for r in landed(spark, records).orderBy("ingest_seq").collect()] == [("C1", "1.5", None, 0), ("C2", None, None, 1)]
        answers[:] = [("application/json", b"no")]
        with pytest.raises(ValueError, match="is no JSON"):
            one_shot(f"http://127.0.0.1:{server.server_port}/", retries=2, sleep=waits.append)
    finally:
        server.shutdown()


def test_any_date(spark):
    texts = ["2024-01-05", "2024-01-05 13:00:00", "20240105", "01/05/2024", "2024/01/05", "x", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("stamp", F.lit("2024-01-05 23:59:59").cast("timestamp"))
    got = rows.orderBy("i").select(any_date(F.col("t")).alias("a"), any_date(F.col("stamp")).alias("b"), any_date(F.to_date("stamp")).alias("c")).collect()
    assert [str(r.a) for r in got] == ["2024-01-05"] * 5 + ["None"] * 3 and {(str(r.b), str(r.c)) for r in got} == {("2024-01-05", "2024-01-05")}
