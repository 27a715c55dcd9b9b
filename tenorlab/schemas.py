"""Fixed schemas of the stored tables and connector frames."""

from __future__ import annotations

from pyspark.sql import types as T

_DATE, _STR, _DBL, _LNG, _TS, _BOOL = T.DateType(), T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType(), T.BooleanType()


def _table(kind_by_name: dict[str, T.DataType], required: str = "") -> T.StructType:
    return T.StructType([T.StructField(n, k, n not in required.split()) for n, k in kind_by_name.items()])


AUCTIONS = _table(
    {"cusip": _STR}
    | dict.fromkeys("auction_date issue_date maturity_date record_date announcement_date dated_date call_date first_int_payment_date".split(), _DATE)
    | dict.fromkeys("security_type original_security_term inflation_index_security floating_rate reopening".split(), _STR)
    | dict.fromkeys("int_rate high_yield low_yield avg_med_yield bid_to_cover_ratio total_accepted total_tendered".split(), _DBL)
    | {"offering_amt": _STR, "ingest_seq": _LNG},
    "ingest_seq",
)
UST_EOD = _table(
    {"ts": _DATE, "cusip": _STR} | dict.fromkeys("px_last yld_ytm_mid px_bid px_ask bid_yield ask_yield".split(), _DBL) | {"source": _STR, "created_at": _TS},
    "ts cusip source created_at",
)
HEADLINE = _table(
    {"ts": _DATE, "tenor": _STR, "asset_class": _STR, "cusip": _STR, "status": _STR, "px_last": _DBL, "yld_ytm_mid": _DBL}, "ts tenor asset_class cusip status"
)
BREAKEVEN = _table(
    {"ts": _DATE, "tenor": _STR, "status": _STR, "nominal_cusip": _STR, "tips_cusip": _STR, "nominal_yield": _DBL, "tips_yield": _DBL, "breakeven": _DBL}, "ts tenor status"
)
BARS = _table({"security": _STR, "time": _TS, "open": _DBL, "high": _DBL, "low": _DBL, "close": _DBL, "volume": _LNG, "numEvents": _LNG}, "security time")
TICKS = _table({"security": _STR, "time": _TS, "type": _STR, "value": _DBL, "size": _LNG, "conditionCodes": _STR}, "security time")
INSTRUMENTS = _table({"security": _STR, "description": _STR, "yellowKey": _STR})
FIELDS = _table(dict.fromkeys("id mnemonic description datatype categoryName ftype".split(), _STR))
LIVE = _table({"security": _STR, "event_ts": _TS, "arrival_ts": _TS, "LAST_PRICE": _DBL, "BID": _DBL, "ASK": _DBL, "BID_SIZE": _LNG, "ASK_SIZE": _LNG}, "security")
TICK_FLAGS = _table({"security": _STR, "use_ticks": _BOOL}, "security use_ticks")

#: What identifies a row of each stored table.
KEYS = {"auctions": ("cusip", "auction_date"), "ust_eod": ("cusip", "ts"), "headline": ("ts", "tenor", "asset_class", "status"), "breakeven": ("ts", "tenor", "status")}
