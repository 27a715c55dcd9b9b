import datetime as dt

import pytest

from tenorlab.operators import dml, ingest
from tenorlab.session import shared_path

ROW = "k string, px double, created_at string"


def frame(spark, rows, schema=ROW):
    return spark.createDataFrame(rows, schema)


def test_upsert_keeps_the_first_creation_and_lets_nulls_win(spark):
    old = frame(spark, [("K1", 100.0, "t0"), ("K3", 7.0, "t0")])
    new = frame(spark, [("K1", 101.0, "t1"), ("K2", 50.0, "t1"), ("K3", None, "t1")])
    once = dml.upsert(old, new, ["k"])
    want = [("K1", 101.0, "t0"), ("K2", 50.0, "t1"), ("K3", None, "t0")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, dml.upsert(once, new, ["k"]).collect())) == want


def test_insert_ignore(spark):
    old, new = frame(spark, [("K1", 100.0, "t0")]), frame(spark, [("K1", 101.0, "t1"), ("K2", 50.0, "t1"), (None, 1.0, "t1")])
    assert sorted((str(r[0]), r[1]) for r in dml.insert_ignore(old, new, ["k"]).collect()) == [("K2", 50.0), ("None", 1.0)]
    both = old.union(dml.insert_ignore(old, new.where("k is not null"), ["k"]))
    assert dml.insert_ignore(both, new.where("k is not null"), ["k"]).count() == 0


def test_keep_last(spark):
    rows = frame(spark, [("A", "d1", 1, "x"), ("A", "d1", 2, "y"), ("A", "d2", 3, "z")], "k string, d string, seq int, v string")
    assert sorted(r.v for r in dml.keep_last(rows, ["k", "d"], ["seq"]).collect()) == ["y", "z"]


def test_incremental_decisions(spark):
    days = [dt.date(2024, 1, i) for i in range(1, 6)]
    table = lambda d: frame(spark, [(x, 1.0) for x in d], "ts date, v double")
    assert dml.build(lambda: table([]), table(days))[0] == "nothing"
    assert dml.build(lambda: table(days), table([]))[0] == "full" and dml.build(lambda: table(days), None)[0] == "full"
    assert dml.build(lambda: table(days), table(days))[0] == "nothing"
    mode, rows = dml.build(lambda: table(days), table(days[:3]))
    assert mode == "append" and sorted(r.ts for r in rows.collect()) == days[3:]
    assert dml.build(lambda: table(days), table(days[:3]), mode="full")[0] == "full"


def test_full_refresh_may_read_its_own_target(spark):
    path = shared_path(spark, "test")
    rows = frame(spark, [("a", 1.0, "t0"), ("b", 2.0, "t0")])
    kept = dml.full_refresh(rows, path)
    assert dml.full_refresh(kept.where("k = 'b'"), path).count() == 1
    dml.append(rows.where("k = 'a'"), path)
    assert spark.read.parquet(path).count() == 2


def test_unique_assertion(spark):
    with pytest.raises(ValueError):
        dml.assert_unique(frame(spark, [("a", 1.0, ""), ("a", 2.0, "")]), ["k"])


def test_records_are_normalised(spark):
    rows = frame(spark, [("C1", "2024-01-05", "4.25", 1), ("C1", "2024-01-05", "x", 2), ("C2", "null", "", 3), ("C3", "abc", None, 4)], "Cusip string, `Auction Date` string, highYield string, ingest_seq long")
    got = {r.cusip: (r.auction_date, r.high_yield) for r in ingest.auctions_from_records(rows).collect()}
    assert got == {"C1": (dt.date(2024, 1, 5), None), "C2": (None, None), "C3": (None, None)}


def test_the_second_of_two_incoming_rows_is_ignored(spark):
    old, new = frame(spark, [("K1", 1.0, "t0")]), frame(spark, [("K2", 5.0, "b"), ("K2", 4.0, "a"), ("K1", 2.0, "a"), (None, 1.0, "a"), (None, 1.0, "a")])
    got = sorted((str(r.k), r.px) for r in dml.insert_ignore(old, new, ["k"], ["created_at"]).collect())
    assert got == [("K2", 4.0), ("None", 1.0), ("None", 1.0)]


def test_loads_tell_their_rows(spark):
    path = shared_path(spark, "count")
    rows = frame(spark, [("a", 1.0, "t0"), ("b", 2.0, "t0")])
    assert dml.written(rows, lambda r: dml.full_refresh(r, path)) == 2 and dml.written(rows, lambda r: dml.append(r, path)) == 2
    told = []
    assert dml.in_batches([f"S{i}" for i in range(12)], len, on_progress=lambda *x: told.append(x)) == 12 and told == [(1, 3, 5), (2, 3, 10), (3, 3, 12)]


def test_a_failed_refresh_leaves_the_old_table(spark):
    path = shared_path(spark, "keep")
    dml.full_refresh(frame(spark, [("a", 1.0, "t0")]), path)
    with pytest.raises(Exception):
        dml.full_refresh(frame(spark, [("b", 2.0, "t0")]).selectExpr("k", "px", "raise_error('no') as created_at"), path)
    assert [r.k for r in spark.read.parquet(path).collect()] == ["a"]


def test_each_key_goes_on_from_its_own_mark(spark):
    at = lambda k, i: (k, i, 1.0)
    source = spark.createDataFrame([at(k, i) for k in ("A", "B", "C") for i in range(4)] + [at(None, 3)], "k string, ts int, v double")
    sink = spark.createDataFrame([at("A", 3), at("B", 1), at("B", 0), at(None, 2)], "k string, ts int, v double")
    assert sorted((str(r.k), r.ts) for r in dml.incremental_by_key(source, sink, "k").collect()) == [("B", 2), ("B", 3), *[("C", i) for i in range(4)], ("None", 3)]


def test_securities_keep_the_last_of_each_issue(spark):
    rows = frame(spark, [("C1", "2024-01-05", "4.25", 1), ("C1", "2024-01-05", "x", 2), ("C1", "2024-02-05", "4.5", 3)], "Cusip string, `Issue Date` string, `Interest Rate` string, ingest_seq long")
    got = {(r.cusip, r.issue_date): r.interest_rate for r in ingest.securities_from_records(rows).collect()}
    assert got == {("C1", dt.date(2024, 1, 5)): None, ("C1", dt.date(2024, 2, 5)): 4.5}
    assert ingest.DATES[:2] == ("auction_date", "issue_date") and "high_yield" in ingest.NUMBERS


def test_tables_are_built_by_command(spark, tmp_path, capsys):
    import json

    from tenorlab import jobs

    pages = []
    for i, day in enumerate(("2024-01-10", "2024-02-01")):
        pages.append(str(tmp_path / f"{i}.json"))
        bond = {"cusip": f"N{i}", "auction_date": day, "maturity_date": "2034-01-15", "security_type": "Note", "original_security_term": "10-Year", "inflation_index_security": "No"}
        linker = bond | {"cusip": f"T{i}", "inflation_index_security": "Yes"}
        (tmp_path / f"{i}.json").write_text(json.dumps({"data": [bond, bond, linker], "links": {}}))
    store = f"file://{tmp_path}/store"
    assert jobs.pull_auctions(spark, store, files=json.dumps(pages[:1])) == ("full", 2)
    assert jobs.pull_auctions(spark, store, files=json.dumps(pages)) == ("append", 2)
    assert jobs.pull_auctions(spark, store, files=json.dumps(pages)) == ("append", 0)
    days = [dt.date(2024, 1, 10), dt.date(2024, 1, 20), dt.date(2024, 2, 1)]
    eod = lambda d: spark.createDataFrame([(x, c, 100.0, 4.0 if c[0] == "N" else 2.0) for x in d for c in ("N0", "N1", "T0", "T1")], "ts date, cusip string, px_last double, yld_ytm_mid double")
    eod(days[:2]).write.parquet(f"{store}/ust_eod.parquet")
    assert jobs.build(spark, store, "headline") == ("full", 4) and jobs.build(spark, store, "headline") == ("nothing", 0)
    eod(days[2:]).write.mode("append").parquet(f"{store}/ust_eod.parquet")
    assert jobs.main(["headline", "--store", store]) == 0 and "headline: 4 rows, append" in capsys.readouterr().out
    assert jobs.build(spark, store, "breakeven", rebuild=True) == ("full", 4)
    got = {(str(r.ts), r.tips_cusip, r.nominal_cusip, r.breakeven) for r in spark.read.parquet(f"{store}/breakeven.parquet").collect()}
    assert got == {("2024-01-10", "T0", "N0", 2.0), ("2024-01-20", "T0", "N0", 2.0), ("2024-02-01", "T0", "N0", 2.0), ("2024-02-01", "T1", "N1", 2.0)}
    assert jobs.main(["headline", "refresh", "--store", store]) == 0 and "headline: 8 rows, full" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        jobs.main(["auctions", "--store", store])


def test_tables_are_made_once(spark):
    path = shared_path(spark, "made")
    rows = frame(spark, [("a", 1.0, "t0")])
    assert dml.ensure_table(spark, path, rows.schema) and not dml.ensure_table(spark, path, rows.schema)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == rows.columns
