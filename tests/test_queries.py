"""Every query of the library against its SQL, and the driver's contract."""

import pytest

import __spark_entry__ as entry_module
from lectern.plans import queries as own

ROWS_ONLY = {"page_texts", "parsed_pages"}


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_against_sql(name, spark, sf, duck, same):
    got = own.QUERIES[name](spark, sf).toPandas()
    assert len(got) or name == "scanned_documents", "an empty result proves nothing"
    if name in own.ORACLES:
        same(got, duck.sql(own.ORACLES[name]).df())
    else:
        assert name in ROWS_ONLY


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.count() == 200
    assert {"doc_id", "estimated_tokens", "chapters_detected", "start_line", "end_line"} <= set(out.columns)


def test_registered():
    assert set(own.QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
