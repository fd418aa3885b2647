import json
import threading
import urllib.error
import urllib.request
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidelake import cli
from tidelake.operators.api import DataApi
from tidelake.operators.factors import FactorRegistry
from tidelake.plans.backtest import JobLedger, Jobs
from tidelake.serve import Service, server
from tidelake.sources.lake import Lake

HOLD = """
def initialize(context):
    g["bought"] = 0

def handle_data(context, data):
    if not g["bought"]:
        g["bought"] = 1
        order(sorted(data)[0], 100)
        log("bought")
"""


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("cli")
    lake = Lake(spark, str(home / "lake"))
    rows = [(c, date(2024, 1, d), 10.0 + k * d % 5, 1e6) for k, c in ((1, "600000.SH"), (2, "000001.SZ"), (3, "000002.SZ")) for d in range(2, 25)]
    bars = spark.createDataFrame(rows, "ts_code string, trade_date date, close double, vol double")
    lake.write("bars_daily", bars.selectExpr("*", "close AS open", "close AS high", "close AS low"))
    lake.write("corporate_actions", spark.createDataFrame([("000001.SZ", date(2024, 1, 10), 0.5)], "ts_code string, ex_date date, bonus_ps double"))
    (home / "hold.py").write_text(HOLD)
    return home


def told(spark, home, *argv):
    lines = []
    assert cli.run(cli.parser().parse_args(["--lake", str(home / "lake"), *argv]), spark, lines.append) == 0
    return [json.loads(x) for x in lines]


def test_commands(spark, home):
    assert told(spark, home, "query", "daily", "--params", '{"ts_code": "600000.SH", "limit": "2"}', "--fields", "trade_date,close")[0]["data"]["items"] == [["20240102", 12.0], ["20240103", 13.0]]
    assert len(told(spark, home, "scan", "bars_daily", "--filter", "ts_code=600000.SH|000001.SZ", "--start", "20240110", "--end", "20240111")) == 4
    seen = told(spark, home, "diagnose", "bars_daily", "--filter", "ts_code=600000.SH", "--start", "20240120")[0]
    assert seen["rows"] == seen["rows_read"] > 5 and 0 < seen["bytes_read"] <= seen["bytes"]
    told(spark, home, "build-cross")
    lake = Lake(spark, str(home / "lake"))
    at = lake.version("bars_daily")
    lake.write("bars_daily", lake.read("bars_daily").withColumn("close", F.when(F.col("trade_date") == date(2024, 1, 10), 77.0).otherwise(F.col("close"))).drop("year"), "replace")
    seen = told(spark, home, "compare", "bars_daily", "--left", str(at), "--right", str(at + 1))
    assert seen[0]["status"] == "differs" and {(r["field"], r["right"]) for r in seen[1:]} == {("close", "77.0")}
    lake.write("bars_daily", lake.read("bars_daily", at).drop("year"), "replace")
    assert {r["dataset"]: r["status"] for r in told(spark, home, "verify")}["daily_cross"] == "ok"
    assert told(spark, home, "dedupe", "bars_daily") == [] and told(spark, home, "reconcile", "bars_daily") == [{"dataset": "bars_daily", "rows": 0}]
    health = told(spark, home, "health")
    assert 0 < health[-1]["disk"]["lake"] < health[-1]["disk"]["capacity"]
    assert {h["dataset"] for h in health[:-1] if h["files"]} == {"bars_daily", "daily_cross", "corporate_actions"}
    sources = home / "sources.json"
    answer = "import json; print(json.dumps({'fields': ['a'], 'items': [[1]]}))"
    sources.write_text(json.dumps({"sources": {"x": {"kind": "exec", "argv": ["python", "-c", answer]}, "y": {"kind": "nope"}}, "bindings": {"trade_cal": ["x"]}}))
    assert [r.get("name") for r in told(spark, home, "--sources", str(sources), "source", "list")] == ["x", "y"]
    assert told(spark, home, "--sources", str(sources), "source", "check")[0]["ok"] is True
    assert told(spark, home, "--sources", str(sources), "source", "call", "x", "--api", "trade_cal")[0]["items"] == [[1]]
    out = told(spark, home, "backtest", "--strategy", str(home / "hold.py"), "--start", "2024-01-02", "--end", "2024-01-24", "--capital", "100000", "--benchmark", "600000.SH", "--out", str(home / "out.json"))[0]
    kept = json.loads((home / "out.json").read_text())
    # the dividend of 0.5 a share, less a fifth, is in the cash from its day on
    cash = {r["time"]: r["cash"] for r in kept["nav"]}
    assert out["trade_count"] == 1 and cash["2024-01-10"] - cash["2024-01-09"] == pytest.approx(40.0) and kept["nav"][0]["benchmark"] == 12.0 and kept["logs"]


def test_service(spark, home):
    lake = Lake(spark, str(home / "lake"))
    jobs = Jobs(JobLedger(home / "jobs"), 1)
    service = Service(DataApi(lake, {"t"}), FactorRegistry(home / "factors.json"), jobs, lambda c: cli.market_from(lake, c.start, c.end, list(c.universe), 30))
    http = server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", json.dumps(body).encode() if body is not None else None, {"X-Token": "t"}, method=method)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("GET", "/healthz")[1]["status"] == "ok" and "requestBody" in call("GET", "/docs/openapi.json")[1]["paths"]["/daily"]["post"]
        assert call("POST", "/", {"api_name": "daily", "params": {"limit": "3"}, "fields": "close", "token": "t"})[1]["data"]["has_more"] is True
        assert call("POST", "/daily", {"token": "x"})[0] == 401 and call("GET", "/nope")[0] == 404
        assert call("POST", "/api/factors", {"id": "m", "kind": "momentum", "name": "m", "params": {"window": 2}})[0] == 200
        assert call("POST", "/api/factors", {"id": "m", "kind": "nope", "name": "m"})[0] == 400
        track = call("POST", "/api/factors/m/track", {"start": "20240105", "end": "20240120", "horizon": 1, "layers": 1})[1]
        assert len(track["ic"]) == 16 and track["stats"]["samples"] == 16 and call("POST", "/api/factors/m/track", {"start": "20240105", "end": "20240120", "horizon": 1, "layers": 1})[1] == track
        ids = [call("POST", "/api/backtests", {"strategy": HOLD, "start": "2024-01-02", "end": "2024-01-24", "universe": ["600000.SH"]})[1]["run_id"] for _ in range(3)]
        ids.append(call("POST", "/api/backtests", {"strategy": "x = 1", "start": "2024-01-02", "end": "2024-01-24"})[1]["run_id"])
        assert [jobs.wait(i)["status"] for i in ids] == ["done", "done", "done", "failed"]
        assert call("GET", f"/api/backtests/{ids[0]}/result")[1]["summary"]["trade_count"] == 1 and len(call("GET", "/api/backtests")[1]) == 4
        assert call("DELETE", "/api/factors/m")[0] == 200 and call("GET", "/api/factors")[1] == []
    finally:
        http.shutdown()


def test_windows_of_minutes_and_frequencies(spark):
    from tidelake.operators.timeseries import frequency, window_days

    given = [(30, 300), (30, 2000), (1, 10), (5, 10**6), (30, 10, 2400), (30, 0)]
    assert list(spark.range(1).select(*[window_days(a, F.lit(n), *rest).alias(f"c{i}") for i, (a, n, *rest) in enumerate(given)]).first()) == [30, 6, 2, 1, 1, 30]
    assert frequency(" Daily ") == "1d" and frequency("1min") == "1m"
    with pytest.raises(ValueError):
        frequency("5m")


def test_named_query_whole_or_by_pages(spark, tmp_path):
    """A page has the query's limit; the whole answer has the rows behind it, too, unless a limit is asked for."""
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = spark.range(6500).select(F.format_string("%06d.SH", "id").alias("ts_code"), F.lit(date(2024, 1, 15)).alias("trade_date"), F.lit(1.0).alias("up_limit"))
    lake.write("stk_limit", rows)
    api = DataApi(lake)
    asked = {"trade_date": "20240115"}
    assert api.rows("stk_limit", asked).count() == 6000
    assert api.rows("stk_limit", asked, whole=True).select("ts_code").distinct().count() == 6500
    assert api.rows("stk_limit", asked | {"limit": "40", "offset": "5"}, whole=True).count() == 40
    assert api.rows("stk_limit", asked | {"offset": "100"}, whole=True).count() == 6400
    assert api.answer("stk_limit", asked)["data"]["has_more"]


def test_registered_queries_are_whole(spark, tmp_path):
    from tidelake.plans import lake_catalog  # noqa: F401  adds to the catalogue
    from tidelake.plans.catalog import QUERIES

    spark.createDataFrame([(k, f"S{k}", 1) for k in range(18100)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    # even keys that aren't delisted: a third of them are
    assert QUERIES["api_stock_basic"](spark, str(tmp_path)).count() == sum(k % 2 == 0 and k % 3 != 1 for k in range(18100)) > 6000
