"""DuckDB SQL of the reference queries."""

from __future__ import annotations

from tenorlab.plans.adapter import LINKER_TENORS, TENORS, TYPES


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_AUCTIONS = """auctions AS MATERIALIZED (
  SELECT CAST(p_partkey AS VARCHAR) AS cusip, CAST(l_shipdate AS DATE) AS auction_date, max(CAST(l_shipdate AS DATE)) OVER (PARTITION BY p_partkey) AS maturity_date,
         p_brand AS term, p_type AS security_type, CASE WHEN p_size % 4 = 0 THEN 'Yes' ELSE 'No' END AS flag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_FIRST = f"""first_auction AS MATERIALIZED (
  SELECT cusip, term AS tenor, flag, min(auction_date) AS first_auction_date, max(maturity_date) AS maturity_date
  FROM auctions WHERE security_type IN {_in(TYPES)} AND term IN {_in(TENORS)} GROUP BY ALL)"""
_TIPS = f"""tips AS (
  SELECT cusip, term AS tenor, min(auction_date) AS first_auction_date
  FROM auctions WHERE flag = 'Yes' AND security_type IN {_in(TYPES)} AND term IN {_in(LINKER_TENORS)} GROUP BY ALL)"""
_EOD = """eod AS MATERIALIZED (
  SELECT CAST(l_shipdate AS DATE) AS ts, CAST(l_partkey AS VARCHAR) AS cusip, avg(l_extendedprice / l_quantity) AS px_last, avg(l_discount) AS yld_ytm_mid
  FROM lineitem GROUP BY 1, 2)"""
_HEADLINE = f"""{_AUCTIONS}, {_FIRST}, {_EOD}, headline AS MATERIALIZED (
  SELECT ts, tenor, asset_class, cusip, CASE rk WHEN 1 THEN 'c' WHEN 2 THEN 'o' WHEN 3 THEN 'oo' WHEN 4 THEN 'ooo' WHEN 5 THEN 'oooo' END AS status, px_last, yld_ytm_mid
  FROM (SELECT e.ts, f.tenor, e.cusip, px_last, yld_ytm_mid, CASE WHEN flag = 'Yes' THEN 'tips' ELSE 'nominal' END AS asset_class,
               row_number() OVER (PARTITION BY e.ts, f.tenor, CASE WHEN flag = 'Yes' THEN 'tips' ELSE 'nominal' END ORDER BY first_auction_date DESC, e.cusip) AS rk
        FROM eod e JOIN first_auction f ON e.cusip = f.cusip AND e.ts >= f.first_auction_date AND e.ts < f.maturity_date)
  WHERE rk <= 5)"""
_PAIRS = f"""{_HEADLINE}, {_TIPS}, pairs AS MATERIALIZED (
  SELECT t.tenor, t.cusip AS tips_cusip, h.cusip AS nominal_cusip, t.first_auction_date
  FROM tips t JOIN headline h ON h.ts = t.first_auction_date AND h.tenor = t.tenor AND h.asset_class = 'nominal' AND h.status = 'c')"""
_BREAKEVEN = f"""{_PAIRS}, be AS (
  SELECT h.ts, p.tenor, h.status, p.nominal_cusip, p.tips_cusip, en.yld_ytm_mid AS nominal_yield, h.yld_ytm_mid AS tips_yield, en.yld_ytm_mid - h.yld_ytm_mid AS breakeven
  FROM headline h JOIN pairs p ON h.cusip = p.tips_cusip JOIN eod en ON en.cusip = p.nominal_cusip AND en.ts = h.ts
  WHERE h.asset_class = 'tips' AND h.status IN ('c', 'o', 'oo') AND en.yld_ytm_mid IS NOT NULL)"""
_OOS = """series AS (SELECT CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS y FROM orders GROUP BY 1),
numbered AS (SELECT ts, y, row_number() OVER (ORDER BY ts) - 1 AS n FROM series),
fits AS (SELECT ts, y, n, regr_slope(y, n) OVER w AS s, regr_intercept(y, n) OVER w AS i, count(y) OVER w AS c
         FROM numbered WINDOW w AS (ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
oos AS (SELECT ts, i + s * n AS fitted_oos, y - (i + s * n) AS residual_oos, s AS trend_slope, i + s * (n - 100) AS trend_intercept FROM fits WHERE c = 100 AND y IS NOT NULL)"""
_OU = f"""{_OOS},
lagged AS (SELECT ts, lag(residual_oos) OVER (ORDER BY ts) AS lag_resid, residual_oos - lag(residual_oos) OVER (ORDER BY ts) AS d_resid, row_number() OVER (ORDER BY ts) - 1 AS k FROM oos),
raw AS (SELECT ts, k, regr_slope(d_resid, lag_resid) OVER w AS s, regr_intercept(d_resid, lag_resid) OVER w AS i, regr_count(d_resid, lag_resid) OVER w AS c, stddev_samp(d_resid) OVER w AS sg
        FROM lagged WINDOW w AS (ORDER BY ts ROWS BETWEEN 299 PRECEDING AND 1 PRECEDING)),
ou AS (SELECT ts, CAST(c AS BIGINT) AS n_pairs, -s AS theta, CASE WHEN s <> 0 THEN -i / s ELSE 0.0 END AS ou_mu, CASE WHEN -s > 0 THEN ln(2) / -s END AS ou_half_life, sg AS ou_sigma
       FROM raw WHERE k >= 300 AND c >= 50 AND s IS NOT NULL)"""
_PLAUSIBLE = f"{_OU}, good AS (SELECT * FROM ou WHERE ou_half_life > 0 AND ou_half_life < 252 AND ou_sigma IS NOT NULL)"
_LINES = """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, CAST(l_shipdate AS DATE) AS l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS r
  FROM lineitem {where}) WHERE r = 1"""
_OLD, _NEW = _LINES.format(where="WHERE l_returnflag <> 'R'"), _LINES.format(where="WHERE l_returnflag = 'R'")
_TICKS = """ticks AS (SELECT event_type AS security, ts AS time, CASE WHEN event_id % 3 = 0 THEN 'BID' ELSE 'TRADE' END AS type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, 'C' || (event_id % 4) AS conditionCodes, event_id AS seq FROM events)"""


def _bars(minutes: int) -> str:
    return f"""{_TICKS}, bars AS (SELECT security, time_bucket(INTERVAL '{minutes} minutes', time) AS time, arg_min(value, (time, seq)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (time, seq)) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS "numEvents" FROM ticks GROUP BY 1, 2)"""


_HISTORY = """hist AS (SELECT o_orderpriority AS security, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS px_last, min(o_totalprice) AS px_low FROM orders GROUP BY 1, 2)"""
_CACHE = """upd AS (SELECT event_type AS security, ts AS event_ts, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 3 AS m, event_id % 2 = 0 AS even, value FROM events),
cache AS (SELECT security, arg_max(value, (event_ts, seq)) FILTER (m = 0) AS "LAST_PRICE", arg_max(value, (event_ts, seq)) FILTER (m = 1) AS "BID", arg_max(value, (event_ts, seq)) FILTER (m = 2) AS "ASK",
  arg_max(k, (event_ts, seq)) FILTER (m = 1 AND even AND k IS NOT NULL) AS "BID_SIZE", arg_max(k, (event_ts, seq)) FILTER (m = 2 AND even AND k IS NOT NULL) AS "ASK_SIZE", max(event_ts) AS last_ts
  FROM upd GROUP BY security)"""


def _price(p: str, carry: bool = False) -> str:
    w, e = f"CAST(floor({p}) AS BIGINT)", f"CAST(round_even(({p} - floor({p})) * 256, 0) AS BIGINT)"
    if carry:
        w, e = f"({w} + {e} // 256)", f"({e} % 256)"
    return f"""CASE WHEN {p} >= 0 THEN lpad(CAST({w} AS VARCHAR), CAST(greatest(3, length(CAST({w} AS VARCHAR))) AS INTEGER), '0') || '-' || lpad(CAST({e} // 8 AS VARCHAR), 2, '0') ||
  CASE {e} % 8 WHEN 0 THEN '' WHEN 4 THEN '+' ELSE CAST({e} % 8 AS VARCHAR) END END"""


_CURVE = "(VALUES (2), (3), (5), (7), (10), (20), (30))"
_BE_OUT = "ts, tenor, status, nominal_cusip, tips_cusip, round(nominal_yield, 6) AS nominal_yield, round(tips_yield, 6) AS tips_yield, round(breakeven, 6) AS breakeven"
_DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS min, round(quantile_cont({c}, 0.25), 5) AS q25,
  round(quantile_cont({c}, 0.5), 5) AS q50, round(quantile_cont({c}, 0.75), 5) AS q75, round(max({c}), 5) AS max FROM good"""
_PART = "(SELECT p_partkey, p_retailprice / 10 AS p, p_size FROM part)"


def _tickers() -> str:
    by = (
        ("ust", "'USGG' || t || 'YR Index'", (2, 3, 5, 7, 10, 20, 30)), ("sofr_ois", "'USOSFR' || t || ' Curncy'", (2, 3, 5, 7, 10, 20, 30, 4)),
        ("swp_spd", "'USSFCT' || lpad(t, 2, '0') || ' Curncy'", (2, 3, 5, 7, 10, 20, 30)), ("tips", "'USGGT' || lpad(t, 2, '0') || 'Y Index'", (5, 10, 30)),
        ("be", "'USGGBE' || lpad(t, 2, '0') || 'Y Index'", (5, 10, 30)), ("zc", "'USSWIT' || t || ' Curncy'", (2, 3, 5, 7, 10, 20, 30, 1, 4)),
        ("stonk", "t || ' Index'", ("SPX", "NDX", "INDU")), ("sector", "t || ' US Equity'", "XLC XLY XLP XLE XLF XLV XLI XLB XLRE XLK XLU".split()),
        ("prec_met", "t || ' Curncy'", ("XAU", "XAG", "XPT", "XPD")),
        *((n, "t || ' Comdty'", [f"{r}{k}" for r in roots.split() for k in (1, 2)]) for n, roots in (("enrgy", "CL CO NG XB HO"), ("ag", "C W S KC SB CT"), ("ind_met", "HG LA LX LN TIO"))),
    )
    parts = [f"SELECT '{n}' AS list, {form} AS ticker FROM (SELECT unnest([{', '.join(f"'{v}'" for v in values)}]) AS t)" for n, form, values in by]
    return f"SELECT list, ticker, split_part(ticker, ' ', 1) AS root FROM ({' UNION ALL '.join(parts)})"


ORACLES: dict[str, str] = {
    "first_auction": f"WITH {_AUCTIONS}, {_FIRST} SELECT * FROM first_auction",
    "tips_first_issue": f"WITH {_AUCTIONS}, {_TIPS} SELECT * FROM tips",
    "eod_panel": f"WITH {_EOD} SELECT ts, cusip, round(px_last, 9) AS px_last, round(yld_ytm_mid, 6) AS yld_ytm_mid FROM eod",
    "headline_rank": f"WITH {_HEADLINE} SELECT ts, tenor, asset_class, cusip, status, round(px_last, 9) AS px_last, round(yld_ytm_mid, 6) AS yld_ytm_mid FROM headline",
    "headline_current": f"WITH {_HEADLINE} SELECT ts, tenor, asset_class, cusip, round(px_last, 9) AS px_last FROM headline WHERE status = 'c'",
    "headline_status_counts": f"WITH {_HEADLINE} SELECT asset_class, status, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM headline GROUP BY 1, 2",
    "headline_incremental": f"WITH {_HEADLINE} SELECT ts, tenor, asset_class, status, cusip FROM headline WHERE ts > (SELECT max(ts) FROM headline WHERE ts <= DATE '1999-01-01')",
    "tips_nominal_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "breakeven": f"WITH {_BREAKEVEN} SELECT {_BE_OUT} FROM be",
    "breakeven_incremental": f"WITH {_BREAKEVEN} SELECT ts, tenor, status, nominal_cusip, tips_cusip FROM be WHERE ts > (SELECT max(ts) FROM be WHERE ts <= DATE '1999-01-01')",
    "chart_long": f"""WITH {_BREAKEVEN} SELECT ts, tenor, status, 'nominal_yield' AS series, round(nominal_yield, 6) AS value FROM be
        UNION ALL SELECT ts, tenor, status, 'tips_yield', round(tips_yield, 6) FROM be UNION ALL SELECT ts, tenor, status, 'breakeven', round(breakeven, 6) FROM be""",
    "rolling_trend_oos": f"WITH {_OOS} SELECT ts, round(fitted_oos, 2) AS fitted_oos, round(residual_oos, 2) AS residual_oos FROM oos",
    "trend_params": f"WITH {_OOS} SELECT ts, round(trend_slope, 4) AS trend_slope, round(trend_intercept, 2) AS trend_intercept FROM oos",
    "residual_diff": f"WITH {_OOS} SELECT ts, round(lag(residual_oos) OVER (ORDER BY ts), 2) AS lag_resid, round(residual_oos - lag(residual_oos) OVER (ORDER BY ts), 2) AS d_resid FROM oos",
    "ou_params": f"WITH {_OU} SELECT ts, n_pairs, round(theta, 5) AS theta, round(ou_mu, 2) AS ou_mu, round(ou_half_life, 5) AS ou_half_life, round(ou_sigma, 3) AS ou_sigma FROM ou",
    "ou_halflife_filtered": f"WITH {_PLAUSIBLE} SELECT ts, round(ou_half_life, 5) AS ou_half_life, round(ou_sigma, 3) AS ou_sigma FROM good",
    "ou_describe": f"WITH {_PLAUSIBLE} {_DESCRIBE.format(c='theta')} UNION ALL {_DESCRIBE.format(c='ou_half_life')}",
    "series_filtered_ordered": """SELECT CAST(o_orderdate AS DATE) AS ts, o_orderkey, round(o_totalprice, 2) AS price FROM orders
        WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY 1, 2""",
    "distinct_ids": "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS cusip FROM lineitem WHERE l_partkey IS NOT NULL ORDER BY 1",
    "hwm_minmax": """SELECT first_day, last_day, n, least(CAST(last_day + INTERVAL 1 DAY AS DATE), DATE '2001-06-30') AS next_start, least(CAST(last_day + INTERVAL 1 DAY AS DATE), DATE '2001-06-30') = DATE '2001-06-30' AS clamped
        FROM (SELECT min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day, count(*) AS n FROM lineitem)""",
    "dedupe_keep_last": _LINES.format(where=""),
    "insert_ignore": f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT new.* FROM new ANTI JOIN old USING (l_orderkey, l_linenumber)",
    "upsert_merge": f"""WITH old AS ({_OLD}), new AS ({_NEW}) SELECT *, 't0' AS created_at FROM old ANTI JOIN new USING (l_orderkey, l_linenumber)
        UNION ALL SELECT new.*, CASE WHEN old.l_orderkey IS NULL THEN 't1' ELSE 't0' END AS created_at FROM new LEFT JOIN old USING (l_orderkey, l_linenumber)""",
    "full_refresh": f"WITH {_EOD} SELECT ts, cusip, round(px_last, 9) AS px_last, CAST(year(ts) AS INTEGER) AS year FROM eod",
    "schema_align_union": """SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""",
    "normalize_columns": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice AS p_retail_price FROM part",
    "lenient_parse": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN try_cast('19' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '-02-' || lpad(CAST(p_size % 31 + 1 AS VARCHAR), 2, '0') AS DATE) END AS day,
        CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS number, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) END AS whole FROM part""",
    "json_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "schema_probe": """SELECT CAST(column_index - 1 AS INTEGER) AS position, column_name, CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz'
        ELSE CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END END AS data_type
        FROM duckdb_columns() WHERE table_name = 'lineitem'""",
    "explode_bulk": "SELECT o_orderkey AS security, l_linenumber, l_partkey, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey",
    "snapshot_fields": """SELECT c_name AS security, c_acctbal, c_mktsegment, 'USD' AS currency FROM customer
        WHERE c_name IN (SELECT 'Customer#' || lpad(CAST(i AS VARCHAR), 9, '0') FROM range(0, 140, 2) r(i)) AND NOT c_acctbal < 0""",
    "history_range": f"""WITH {_HISTORY} SELECT security, strftime(date, '%Y%m%d') AS day, strftime(date, '%Y-%m-%d') AS iso_day, px_last, px_low FROM hist
        WHERE security IN ('1-URGENT', '5-LOW') AND date BETWEEN DATE '1996-03-01' AND DATE '1998-06-30' ORDER BY 1, 2""",
    "periodic_resample": f"WITH {_HISTORY} SELECT security, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(px_last, date) AS px_last, arg_max(px_low, date) AS px_low FROM hist GROUP BY 1, 2",
    "intraday_bars": f"WITH {_bars(5)} SELECT * FROM bars",
    "bars_gap_filled": f"""WITH {_bars(60)}, grid AS (SELECT security, unnest(generate_series(min(time), max(time), INTERVAL '60 minutes')) AS time FROM bars GROUP BY security),
        joined AS (SELECT g.security, g.time, b.* EXCLUDE (security, time), last_value(close IGNORE NULLS) OVER (PARTITION BY g.security ORDER BY g.time) AS carried FROM grid g LEFT JOIN bars b ON g.security = b.security AND g.time = b.time)
        SELECT security, time, coalesce(open, carried) AS open, coalesce(high, carried) AS high, coalesce(low, carried) AS low, coalesce(close, carried) AS close, coalesce(volume, 0) AS volume, coalesce("numEvents", 0) AS "numEvents" FROM joined""",
    "ticks_filtered": f"""WITH {_TICKS} SELECT time, type, value, size, conditionCodes AS "conditionCodes" FROM ticks
        WHERE security = 'click' AND type = 'TRADE' AND time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-20'""",
    "instrument_search": """SELECT CAST(p_partkey AS VARCHAR) AS security, p_name AS description, p_type AS "yellowKey" FROM part WHERE contains(lower(p_name), 'ring') ORDER BY 2, 1 LIMIT 50""",
    "field_info": """SELECT * FROM (SELECT 'F' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS id, n_name AS mnemonic, 'field of ' || r_name AS description, r_name AS "categoryName"
        FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE mnemonic IN ('NATION_3', 'NATION_7', 'F011', 'NATION_99') OR id IN ('NATION_3', 'NATION_7', 'F011', 'NATION_99')""",
    "topk_latest": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS auction_date, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '2-HIGH'
        ORDER BY 2 DESC NULLS FIRST, 1 LIMIT 40""",
    "tail_n": "SELECT * FROM (SELECT CAST(o_orderdate AS DATE) AS ts, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 10) ORDER BY 1",
    "price_32nds": f"SELECT p_partkey, {_price('p')} AS price, {_price('p', True)} AS carried, round(CASE WHEN p_size / 100 - 0.1 > 0 THEN ln(2) / (p_size / 100 - 0.1) END, 6) AS half_life FROM {_PART}",
    "curve_pairs": f"""SELECT a, b, 'USYC' || a || CASE WHEN a < 10 THEN 'Y' ELSE '' END || b || CASE WHEN b < 10 THEN 'Y' ELSE '' END || ' Index' AS ticker
        FROM {_CURVE} x(a) JOIN {_CURVE} y(b) ON a < b""",
    "fly_triples": f"""SELECT a, b, c, 'BF' || lpad(CAST(a AS VARCHAR), 2, '0') || lpad(CAST(b AS VARCHAR), 2, '0') || lpad(CAST(c AS VARCHAR), 2, '0') || ' Index' AS ticker
        FROM {_CURVE} x(a) JOIN {_CURVE} y(b) ON a < b JOIN {_CURVE} z(c) ON b < c""",
    "ticker_universe": _tickers(),
    "last_value_cache": f"WITH {_CACHE} SELECT * FROM cache",
    "quote_line": f"""WITH {_CACHE} SELECT security, security IN ('click', 'view', 'refund') AS use_ticks, concat_ws(' | ', strftime(last_ts, '%Y-%m-%d %H:%M:%S'), security, 'Last: ' || ({_price('"LAST_PRICE"')}),
        'Bid: ' || ({_price('"BID"')}), 'Ask: ' || ({_price('"ASK"')}), 'BidSz: ' || "BID_SIZE", 'AskSz: ' || "ASK_SIZE") AS line FROM cache""",
}
ORACLES["stream_last_value"] = ORACLES["last_value_cache"]
ORACLES["stream_bars"] = f"WITH {_bars(60)} SELECT * FROM bars"
