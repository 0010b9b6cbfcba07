import datetime as dt
import os

from pyspark.sql import functions as F

from lakewright.diagnostics import access_diagnostics, main, run_diagnostics, write_diagnostics
from lakewright.operators.governance import Policy
from lakewright.sources.files import read_json
from tests.conftest import SF_SMALL


def test_access_diagnostics_with_missing_table(spark):
    ev = f"{SF_SMALL}/events.parquet"
    res = access_diagnostics(spark, [ev, "default.no_such_table"], "r1",
                             {ev: Policy("p", row_filter="user_id < 50", hidden_columns=("props",))})
    got = {(r.table_name, r.check_name): (r.status, r.observed) for r in res.collect()}
    n = spark.read.parquet(ev).where("user_id < 50").count()
    assert got[(ev, "rows behind the row policy")] == ("INFO", n)
    assert got[(ev, "hidden columns")] == ("INFO", 1)
    status, _ = got[("default.no_such_table", "readable rows")]
    assert status == "FAIL"
    msg = [r.message for r in res.collect() if r.table_name == "default.no_such_table"][0]
    assert "TABLE_OR_VIEW_NOT_FOUND" in msg


def test_write_diagnostics(spark, tmp):
    df = spark.read.parquet(f"{SF_SMALL}/customer.parquet").limit(50)
    res = {r.check_name: r for r in write_diagnostics(df, tmp, "r2").collect()}
    assert set(res) == {"JSON Write", "PARQUET Write", "CSV Write"}
    assert all(r.status == "PASS" and r.observed == 50 for r in res.values())


def test_report_and_cli(spark, tmp):
    rep = run_diagnostics(spark, [f"{SF_SMALL}/orders.parquet"], "r3", "job",
                          write_path=os.path.join(tmp, "w")).first()
    assert rep.total_checks == 6 and rep.passed == 3 and rep.failed == 0
    path = main(["--tables", f"{SF_SMALL}/orders.parquet", "--output", os.path.join(tmp, "out"),
                 "--run-id", "r4"])
    back = read_json(spark, path).first()
    assert back.run_id == "r4" and back.total_checks == 3
