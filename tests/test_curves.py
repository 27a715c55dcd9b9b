import datetime as dt

import pytest

from tenorlab.operators import curves
from tenorlab.operators.dml import assert_unique

D = dt.date.fromisoformat
AUCTIONS = "cusip string, auction_date date, maturity_date date, security_type string, original_security_term string, inflation_index_security string"
EOD = "ts date, cusip string, px_last double, yld_ytm_mid double"


def auctions(spark, *more):
    rows = [
        ("N1", "2024-01-10", "2034-01-15", "No"), ("N1", "2024-02-10", "2034-01-15", "No"), ("N2", "2024-02-01", "2034-02-15", "No"),
        ("T1", "2024-01-20", "2034-01-15", "Yes"), *more,
    ]
    return spark.createDataFrame([(c, D(a), D(m), "Note", "10-Year", f) for c, a, m, f in rows], AUCTIONS)


def eod(spark, days, cusips=("N1", "N2", "T1"), yields=None):
    y = yields or {}
    return spark.createDataFrame([(D(d), c, 100.0, y.get((c, d), 4.0)) for d in days for c in cusips], EOD)


DAYS = ["2024-01-09", "2024-01-10", "2024-02-01", "2024-02-10"]


def test_ranking_follows_first_auctions(spark):
    got = {(str(r.ts), r.asset_class, r.status, r.cusip) for r in curves.headline(eod(spark, DAYS), auctions(spark)).collect()}
    later = {("nominal", "c", "N2"), ("nominal", "o", "N1"), ("tips", "c", "T1")}
    assert got == {("2024-01-10", "nominal", "c", "N1")} | {(d, *x) for d in DAYS[2:] for x in later}


def test_maturity_day_is_out_and_rank_six_is_dropped(spark):
    more = [(f"X{i}", f"2024-03-0{i}", "2034-03-15", "No") for i in range(1, 6)]
    names = ["N1", "N2", *(m[0] for m in more)]
    ranked = curves.headline(eod(spark, ["2034-01-15", "2024-03-20"], names), auctions(spark, *more))
    assert_unique(ranked, ["ts", "tenor", "asset_class", "status"])
    got = {(str(r.ts), r.status): r.cusip for r in ranked.collect()}
    assert got[("2024-03-20", "c")] == "X5" and got[("2024-03-20", "oooo")] == "X1"
    assert ("2034-01-15", "oooo") in got and "N1" not in {c for (d, _), c in got.items() if d == "2034-01-15"}


def test_tie_and_null_flag(spark):
    more = [("A2", "2024-02-01", "2034-02-15", "No"), ("B0", "2024-02-05", "2034-02-15", None)]
    rows = curves.headline(eod(spark, ["2024-02-10"], ("N2", "A2", "B0")), auctions(spark, *more)).collect()
    assert [(r.cusip, r.asset_class) for r in sorted(rows, key=lambda r: len(r.status) + (r.status != "c"))] == [("B0", "nominal"), ("A2", "nominal"), ("N2", "nominal")]


@pytest.mark.parametrize(("n1", "t1", "want"), [(4.10, 1.85, [2.25]), (None, 1.85, []), (4.10, None, [None])])
def test_breakeven_pair_stays(spark, n1, t1, want):
    y = {("N1", "2024-02-01"): n1, ("T1", "2024-02-01"): t1}
    prices = eod(spark, ["2024-01-20", "2024-02-01"], yields=y)
    ranked = curves.headline(prices, auctions(spark))
    pairs = curves.tips_nominal_pairs(curves.tips_first_issues(auctions(spark)), ranked)
    assert [(r.tips_cusip, r.nominal_cusip) for r in pairs.collect()] == [("T1", "N1")]
    rows = [r for r in curves.breakeven(ranked, pairs, prices).collect() if str(r.ts) == "2024-02-01"]
    assert [None if r.breakeven is None else round(r.breakeven, 9) for r in rows] == want


def test_no_price_on_the_first_day_gives_no_pair(spark):
    ranked = curves.headline(eod(spark, ["2024-02-01"]), auctions(spark))
    assert curves.tips_nominal_pairs(curves.tips_first_issues(auctions(spark)), ranked).count() == 0


def test_a_linker_reopened_under_another_term_counts_in_both(spark):
    ranked = spark.createDataFrame([(D("2024-02-01"), "10-Year", "tips", "T1", "c", 99.0, 1.9)], "ts date, tenor string, asset_class string, cusip string, status string, px_last double, yld_ytm_mid double")
    pairs = spark.createDataFrame([("10-Year", "T1", "N1"), ("5-Year", "T1", "N2")], "tenor string, tips_cusip string, nominal_cusip string")
    got = {(r.tenor, r.nominal_cusip, round(r.breakeven, 6)) for r in curves.breakeven(ranked, pairs, eod(spark, ["2024-02-01"], yields={("N2", "2024-02-01"): 4.5})).collect()}
    assert got == {("10-Year", "N1", 2.1), ("5-Year", "N2", 2.6)}
