"""Every registered query against its DuckDB twin on the same parquet.

Runs at sf0.001 (small and fast); tools/oracle_check.py runs sf0.01.
"""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if hasattr(v, "item"):
        return v.item()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_file_metadata():
    from lakewright.plans.queries import QUERIES
    missing = set(QUERIES) - set(E.oracle_sql())
    assert missing == {"file_inventory", "compaction_plan", "object_listing"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    got_arrow = sdf.toArrow()
    want_arrow = duck.sql(E.oracle_sql()[name]).to_arrow_table()
    # Same column types as Arrow sees them (int32/int64, timestamp[us] without zone, ...).
    assert {f.name: str(f.type) for f in got_arrow.schema} == {f.name: str(f.type) for f in want_arrow.schema}
    got = got_arrow.to_pandas()
    want = want_arrow.to_pandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got) == _rows(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:5] == ["id", "event_type", "user_id", "event_data", "event_timestamp"]


@pytest.mark.parametrize("name", ["file_inventory", "compaction_plan"])
def test_rows_only_queries(spark, name):
    rows = E.queries()[name](spark, SF_SMALL).collect()
    assert len(rows) == 1
    assert rows[0]["rows"] == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_object_listing(spark):
    import os
    rows = E.queries()["object_listing"](spark, SF_SMALL).collect()
    assert sorted(r.name for r in rows) == sorted(os.listdir(SF_SMALL))
    assert all(r.bytes == os.path.getsize(os.path.join(SF_SMALL, r.name)) for r in rows)


def test_listing_summary(spark):
    import os
    from lakewright.sources.files import list_objects, listing_summary
    r = listing_summary(list_objects(spark, SF_SMALL)).first()
    assert r.objects == len(os.listdir(SF_SMALL))
    assert r.first_names == sorted(os.listdir(SF_SMALL))[:5]
