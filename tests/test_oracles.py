import pytest

import __spark_entry__ as entry
from tests.duck import same_rows
from tenorlab.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    same_rows(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_every_query_is_registered(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["ts", "tenor", "asset_class", "cusip", "status", "px_last", "yld_ytm_mid"]
    assert df.count() > 0


def test_schema_probe(spark, sf):
    rows = QUERIES["schema_probe"](spark, sf).collect()
    assert ("l_orderkey", "bigint") in {(r.column_name, r.data_type) for r in rows}
