import json
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.functions import dates, market
from tidelake.operators.api import ApiError, DataApi, page
from tidelake.operators.predicates import Predicate as P
from tidelake.operators.predicates import applied
from tidelake.registry import Registry, market as market_registry
from tidelake.sources import ingest, remote
from tidelake.sources.lake import Lake, migrated, old_mapping, reconciled_partitions
from tidelake.sources.versions import STATE_EVERY, Conflict, Versions


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    bars = [("600000.SH", date(2023, 1, 3), 10.0), ("600000.SH", date(2023, 1, 4), 10.5), ("000001.SZ", date(2023, 1, 5), 20.0), ("600000.SH", date(2024, 2, 1), 11.0), ("600000.SH", date(2024, 2, 2), 11.5)]
    lake.write("bars_daily", spark.createDataFrame(bars, "ts_code string, trade_date date, close double"))
    minutes = [("600000.SH", datetime(2024, 1, 2, 9, 31), 1234.5, 1234.5)]
    lake.write("bars_1m", spark.createDataFrame(minutes, "ts_code string, trade_time timestamp_ntz, vol double, amount double").withColumn("market", F.lit("hs")))
    for kind, f in (("hfq", 10.5), ("qfq", 1.05)):
        lake.write("adj_factor", spark.createDataFrame([("600000.SH", date(2024, 1, 2), f)], "ts_code string, trade_date date, adj_factor double").withColumn("factor_type", F.lit(kind)))
    return lake


def test_registry_rejects_what_it_must():
    ok = {"version": 1, "datasets": {"d": {"root": "d", "fields": [{"name": "a", "type": "string"}], "primary_key": ["a"]}}}
    assert Registry.of(ok)["d"].names == ["a"]
    for path, value in (("version", 2), ("datasets", {})):
        with pytest.raises(ValueError):
            Registry.of(ok | {path: value})
    bad = [{"root": ""}, {"fields": []}, {"primary_key": ["b"]}, {"sorted_by": ["b"]}, {"partitions": ["a"]}, {"fields": [{"name": "a", "type": "int32"}]}, {"fields": [{"name": "a", "type": "string"}] * 2}]
    for change in bad:
        with pytest.raises(ValueError):
            Registry.of({"version": 1, "datasets": {"d": ok["datasets"]["d"] | change}})
    assert len(list(market_registry())) == 12 and market_registry()["stock_basic"].time_field == "list_date"


def test_scan(lake):
    rows = lake.scan("bars_daily").collect()
    assert len(rows) == 5 and rows[0].pe is None and "year" not in lake.scan("bars_daily").columns
    some = lake.scan("bars_daily", [P("ts_code", "=", "600000.SH"), P("trade_date", ">=", date(2023, 1, 1)), P("trade_date", "<=", date(2023, 12, 31))], ["close", "ts_code"])
    assert [tuple(r) for r in some.orderBy("close").collect()] == [(10.0, "600000.SH"), (10.5, "600000.SH")]
    assert len({r.f for r in some.select(F.input_file_name().alias("f")).collect()}) >= 1
    assert all("year=2023" in f for f in some.withColumn("f", F.input_file_name()).select("f").toPandas().f)
    assert [r.close for r in lake.scan("bars_daily", limit=5, offset=1).collect()] == [10.0, 10.5, 11.0, 11.5]
    pages = [r for o in range(0, 6, 2) for r in lake.scan("bars_daily", limit=2, offset=o).collect()]
    assert pages == lake.scan("bars_daily", limit=10).collect()
    assert lake.scan("bars_daily", partitions={"year": ["2024"]}).count() == 2
    assert lake.scan("bars_daily", [P("ts_code", "in", ())]).count() == 0
    assert lake.scan("bars_daily", [P("close", ">", "10")]).count() == 0  # another kind is never true
    assert lake.scan("bars_daily", [P("ts_code", "in", tuple(f"{i:06d}.SH" for i in range(600000, 602000)))]).count() == 4
    assert lake.scan("bars_daily", [P("trade_date", ">", date(2024, 2, 1)), P("close", "<", 99.0)]).count() == 1
    with pytest.raises(KeyError):
        lake.scan("bars_daily", columns=["nope"])
    with pytest.raises(KeyError):
        lake.scan("bars_daily", partitions={"nope": ["1"]})


@pytest.mark.parametrize("lo,hi,kept", [("20191229", "20200102", {"2019-12", "2020-01"}), ("20240115", "20240210", {"2024-01", "2024-02"}), ("20200102", "20200102", {"2020-01"}), ("20240102", "20241231", {f"2024-{m:02d}" for m in range(1, 13)})])
def test_partitions_that_a_range_leaves(spark, lo, hi, kept):
    from tidelake.operators.predicates import implied_partitions

    d = market_registry()["bars_1m"]
    at = lambda s: datetime.strptime(s, "%Y%m%d")
    months = spark.createDataFrame([(str(y), f"{m:02d}") for y in (2019, 2020, 2024) for m in range(1, 13)], "year string, month string")
    found = months.where(implied_partitions(d, [P("trade_time", ">=", at(lo)), P("trade_time", "<=", at(hi))]))
    assert {f"{r.year}-{r.month}" for r in found.collect()} == kept


def test_queries(lake):
    api = DataApi(lake, {"t"})
    out = api.answer("daily", {"ts_code": "600000.SH", "trade_date": "20230104"}, "ts_code,trade_date,close", "t")
    assert out == {"code": 0, "msg": "", "data": {"fields": ["ts_code", "trade_date", "close"], "items": [["600000.SH", "20230104", 10.5]], "has_more": False}}
    assert api.answer("daily", {"limit": "1"}, "", "t")["data"]["has_more"] is True
    assert api.answer("stk_mins", {"ts_code": "600000.SH", "start_date": "2024-01-02 09:00:00"}, "trade_time,vol,amount", "t")["data"]["items"] == [["2024-01-02 09:31:00", 123450.0, 1234500.0]]
    assert api.answer("adj_factor", {}, "adj_factor", "t")["data"]["items"] == [[10.5]]
    assert api.answer("adj_factor", {"factor_type": "qfq"}, "adj_factor", "t")["data"]["items"] == [[1.05]]
    for name, params, fields, token in (("daily", {}, "pe_ttm", "t"), ("nope", {}, "", "t"), ("daily", {}, "", "x"), ("stk_mins", {"freq": "5min"}, "", "t"), ("daily", {"start_date": "x"}, "", "t")):
        assert api.answer(name, params, fields, token)["code"] != 0
    assert page({}, 6000, 10000) == (6000, 0) and page({"limit": "x", "offset": -3}, 5, 9) == (5, 0) and page({"limit": 99}, 5, 9) == (9, 0)
    assert len(api.openapi()["paths"]) == 11 and api.health()["datasets"]["bars_daily"] >= 2
    with pytest.raises(ApiError):
        api.rows("nope")


def test_parameters_of_time():
    assert dates.datetime_parameter("20240102 09:31:00") == dates.datetime_parameter("2024-01-02 09:31") == datetime(2024, 1, 2, 9, 31)
    assert dates.date_parameter("2024/01/02") == date(2024, 1, 2)
    for bad in ("2024/01/02", "", "2024-1-2"):
        with pytest.raises(ValueError):
            dates.datetime_parameter(bad)
    assert market.listed(" a, ,b,") == ["a", "b"]


def test_maintenance(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    bars = spark.createDataFrame([("a", date(2023, 1, 3), 1.0), ("b", date(2023, 1, 3), 2.0), ("a", date(2024, 1, 3), 3.0)], "ts_code string, trade_date date, close double")
    lake.write("bars_daily", bars)
    lake.write("bars_daily", bars.where("close = 1"))
    status = {r.dataset: r.status for r in lake.verify().collect()}
    assert status["bars_daily"] == "ok" and status["trade_cal"] == "no-manifest"
    assert [(r.year, r.rows, r.duplicates) for r in lake.dedupe("bars_daily").collect()] == [("2023", 3, 1)]
    lake.dedupe("bars_daily", apply=True)
    assert lake.read("bars_daily").count() == 3 and lake.dedupe("bars_daily").count() == 0
    assert {r.dataset: r.status for r in lake.verify().collect()}["bars_daily"] == "ok"
    lake.log("bars_daily", "import", 5)
    assert {r.dataset: r.status for r in lake.verify().collect()}["bars_daily"] == "mismatch"
    lake.reconcile("bars_daily")
    assert {r.dataset: r.status for r in lake.verify().collect()}["bars_daily"] == "ok" and lake.reconcile("bars_daily") is None
    lake.build_cross(["2023"])
    assert lake.partition_values("daily_cross", "year") == {"2023"}
    assert lake.cross(columns=["ts_code", "trade_date", "close"]).count() == 3  # 2024 from the bars
    lake.write("bars_daily", bars.where("close = 3").withColumn("close", F.lit(9.0)), "replace")
    assert sorted(r.close for r in lake.read("bars_daily").collect()) == [1.0, 2.0, 9.0]
    assert lake.recent(2).count() == 2 and lake.summary().count() == 2
    diff = reconciled_partitions(bars.select("ts_code"), bars.where("close < 3").select("ts_code"), ["ts_code"]).collect()
    assert {r.ts_code: r.status for r in diff} == {"a": "mismatch", "b": "ok"}


def test_writes_that_fail_leave_what_was_there(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path))
    bars = spark.createDataFrame([("a", date(2023, 1, 3), 1.0), ("b", date(2024, 1, 3), 2.0)], "ts_code string, trade_date date, close double")
    lake.write("bars_daily", bars)
    before, moves = sorted(map(tuple, lake.read("bars_daily").collect())), []
    move = Lake._moved

    def breaks(self, was, now):
        moves.append(now)
        # a reader between two moves sees the last version whole
        assert sorted(map(tuple, lake.read("bars_daily").collect())) == before
        if len(moves) == 2:
            raise OSError("the disk is gone")
        return move(self, was, now)

    monkeypatch.setattr(Lake, "_moved", breaks)
    with pytest.raises(OSError):
        lake.write("bars_daily", bars.withColumn("close", F.lit(9.0)), "replace")
    monkeypatch.undo()
    assert len(moves) == 2 and sorted(map(tuple, lake.read("bars_daily").collect())) == before
    assert {r.dataset: r.status for r in lake.verify().collect()}["bars_daily"] == "ok"
    # a repeat under one label is committed once
    for _ in range(2):
        lake.write("bars_daily", bars, "append", "stream", notes="batch 1", once=True)
    assert lake.read("bars_daily").count() == 4 and lake.write("bars_daily", bars.limit(0), "replace")["rows"] == 0
    big = lake.dedupe("bars_daily", apply=True, max_rows=1).collect()
    assert {r.status for r in big} == {"too large"} and lake.read("bars_daily").count() == 4


def test_versions(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    bars = spark.createDataFrame([("a", date(2023, 1, 3), 1.0), ("b", date(2024, 1, 3), 2.0)], "ts_code string, trade_date date, close double")
    closes = lambda version=None: sorted(r.close for r in lake.read("bars_daily", version).collect())
    lake.write("bars_daily", bars)
    first, held = lake.version("bars_daily"), lake.read("bars_daily")
    lake.write("bars_daily", bars.withColumn("close", F.col("close") + 10), "replace")
    assert closes() == [11.0, 12.0] and closes(first) == [1.0, 2.0] and sorted(r.close for r in held.collect()) == [1.0, 2.0]
    assert lake.vacuum("bars_daily") == 0  # too young
    assert lake.vacuum("bars_daily", older_hours=-1) == 2 and closes() == [11.0, 12.0]
    with pytest.raises(KeyError):
        lake.read("bars_daily", 99)
    # more commits than a state file spares
    for i in range(STATE_EVERY + 3):
        lake.log("bars_daily", "note", 0, notes=str(i))
    assert closes() == [11.0, 12.0] and lake.versions("bars_daily")._names(".state") == [STATE_EVERY]
    assert lake.summary().first().rows == 2


def test_two_writers_at_once(spark, tmp_path):
    """All start together; each commit finds a number of its own, whoever comes first."""
    lake = Lake(spark, str(tmp_path))
    day = lambda y: spark.createDataFrame([(f"w{y}", date(y, 1, 3), float(y))], "ts_code string, trade_date date, close double")
    lake.write("bars_daily", day(2000))
    base, gate = lake.version("bars_daily"), threading.Barrier(4)

    def append(y):
        gate.wait()
        return lake.write("bars_daily", day(y))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(append, [2001, 2001, 2002, 2003]))
    assert sorted(r.close for r in lake.read("bars_daily").collect()) == [2000.0, 2001.0, 2001.0, 2002.0, 2003.0]
    assert lake.version("bars_daily") == base + 4 and {r.dataset: r.status for r in lake.verify("bars_daily").collect()} == {"bars_daily": "ok"}
    # what was read before another commit touched it isn't written back; other partitions don't matter
    with pytest.raises(Conflict):
        lake.write("bars_daily", day(2001), "replace", base=base)
    lake.write("bars_daily", day(2000).withColumn("close", F.lit(7.0)), "replace", base=base)
    assert sorted(r.close for r in lake.read("bars_daily").collect()) == [7.0, 2001.0, 2001.0, 2002.0, 2003.0]
    # a replacement takes what is there when it commits: the append that came between goes, too
    put, late = Versions.put, []

    def slow(self, number, entry):
        if entry["operation"] == "import" and not late:
            late.append(1)
            lake.write("bars_daily", day(2001), operation="between")
        return put(self, number, entry)

    Versions.put = slow
    try:
        lake.write("bars_daily", day(2001).withColumn("close", F.lit(5.0)), "replace")
    finally:
        Versions.put = put
    assert late and sorted(r.close for r in lake.read("bars_daily", None).collect()) == [5.0, 7.0, 2002.0, 2003.0]


def test_a_dedupe_that_is_overtaken(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path))
    bars = spark.createDataFrame([("a", date(2023, 1, 3), 1.0)] * 2, "ts_code string, trade_date date, close double")
    lake.write("bars_daily", bars)
    commit = Lake._commit

    def overtaken(self, dataset, operation, *rest):
        if operation == "dedupe":
            monkeypatch.undo()
            lake.write("bars_daily", bars.limit(1).withColumn("ts_code", F.lit("b")))
        return commit(self, dataset, operation, *rest)

    monkeypatch.setattr(Lake, "_commit", overtaken)
    with pytest.raises(Conflict):
        lake.dedupe("bars_daily", apply=True)
    assert lake.read("bars_daily").count() == 3
    lake.dedupe("bars_daily", apply=True)
    assert sorted(r.ts_code for r in lake.read("bars_daily").collect()) == ["a", "b"]


def test_clustering(spark, tmp_path):
    """Files of whole codes, of which one fills several files alone; overlaps as the footers tell them, before and after."""
    lake = Lake(spark, str(tmp_path))
    rows = [(f"c{i % 40:02d}", date(2023, 1, 1) + timedelta(i // 40), float(i)) for i in range(2000)] + [("c17", date(2022, 1, 1) + timedelta(i), 1.0) for i in range(365 + 300)]
    frame = spark.createDataFrame(rows, "ts_code string, trade_date date, close double")
    for i in range(3):
        lake.write("bars_daily", frame.where(F.col("close") % 3 == i).repartition(2), arranged=True)
    before = lake.version("bars_daily")
    assert all(r.overlapping > 0 for r in lake.overlaps("bars_daily").collect() if r.files > 1 and r.year == "2023")
    lake.cluster("bars_daily", 100)
    assert {r.overlapping for r in lake.overlaps("bars_daily").collect()} == {0} and lake.changes("bars_daily", before, lake.version("bars_daily")).count() == 0
    told = lake.footers("bars_daily").where("field IN ('ts_code', 'trade_date')").groupBy("year", "file", "rows").agg(*[F.max(F.when(F.col("field") == f, F.struct("low", "high"))).alias(f) for f in ("ts_code", "trade_date")]).collect()
    large = [r for r in told if r.ts_code.low == r.ts_code.high == "c17"]
    assert len(large) >= 6 and max(r.rows for r in told) <= 250
    for r in large:  # of one code and year, no two files share a day
        assert not [x for x in large if x is not r and x.year == r.year and x.trade_date.low <= r.trade_date.high and r.trade_date.low <= x.trade_date.high]
    assert lake.verify("bars_daily").first().status == "ok"


def test_a_folder_without_versions_is_adopted(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.partitioned("bars_daily", spark.createDataFrame([("a", date(2023, 1, 3), 1.0)], "ts_code string, trade_date date, close double")).write.partitionBy("year").parquet(lake.path("bars_daily"))
    assert lake.read("bars_daily").count() == 1 and lake.version("bars_daily") == -1
    lake.write("bars_daily", spark.createDataFrame([("b", date(2023, 1, 4), 2.0)], "ts_code string, trade_date date, close double"))
    assert lake.read("bars_daily").count() == 2 and lake.read("bars_daily", 0).count() == 1 and lake.verify("bars_daily").first().status == "ok"


@pytest.mark.parametrize("filters", [[P("close", ">", 170.0)], [P("close", "<=", 30.0), P("ts_code", "=", "c1")], [P("ts_code", "in", ("c0", "c5", 3))], [P("pe", ">=", 1.0)], [P("pe", "<", 1000.0), P("trade_date", "<", date(2023, 2, 10))], [P("ts_code", "in", ())], []])
def test_row_groups_that_a_scan_reads(spark, tmp_path, filters):
    """Against the row groups' own rows: a group is read if the least and the largest values of its rows leave room for the filters."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    lake = Lake(spark, str(tmp_path))
    d, groups = lake.registry["bars_daily"], []
    for year in (2022, 2023):
        rows = [{"ts_code": f"c{i // 40}", "trade_date": date(year, 1 + i // 25 % 12, 1 + i % 25), "close": float((i * 7) % 200 if year == 2022 else i), "pe": None if i < 100 else float(i)} for i in range(200)]
        folder = tmp_path / d.root / f"year={year}"
        folder.mkdir(parents=True)
        pq.write_table(pa.Table.from_pylist(rows, pa.schema([("ts_code", pa.string()), ("trade_date", pa.date32()), ("close", pa.float64()), ("pe", pa.float64())])), folder / "a.parquet", row_group_size=30)
        groups += [(year, rows[i : i + 30]) for i in range(0, 200, 30)]

    def room(year, rows):
        for p in filters:
            known = [r[p.field] for r in rows if r[p.field] is not None]
            values = [v for v in (p.value if p.op == "in" else [p.value]) if known and isinstance(v, type(known[0]))]
            if p.field == "trade_date" and p.op == "<" and year > p.value.year:
                return False
            if not known or not any({"=": min(known) <= v <= max(known), "in": min(known) <= v <= max(known), ">": max(known) > v, ">=": max(known) >= v, "<": min(known) < v, "<=": min(known) <= v}[p.op] for v in values):
                return False
        return True

    told = lake.scan_report("bars_daily", filters, ["close"]).agg(F.sum("row_groups"), F.sum("row_groups_read"), F.sum("rows_read"), F.sum("bytes"), F.sum("bytes_read")).first()
    read = [len(rows) for year, rows in groups if room(year, rows)]
    assert told[:3] == (len(groups), len(read), sum(read)) and told[4] <= told[3] and (told[4] < told[3] or not read)
    assert lake.scan("bars_daily", filters, ["close"]).count() <= told[2]


@pytest.mark.parametrize("field,values", [("ts_code", [f"{i:06d}.SH" for i in range(1001)]), ("trade_date", [date(2023, 1, 1) + timedelta(i) for i in range(1001)]), ("close", [float(i) for i in range(1001)])])
def test_lists_of_any_length_obey_one_rule(spark, tmp_path, field, values):
    """Values of another kind never match, whether the list is filtered or joined; repeats don't count."""
    lake = Lake(spark, str(tmp_path))
    d = lake.registry["bars_daily"]
    rows = spark.createDataFrame([("000003.SH", date(2023, 1, 4), 3.0), ("x", date(2030, 1, 1), 5000.0)], "ts_code string, trade_date date, close double")
    others = [datetime(2030, 1, 1), "5000", 5000, True, b"x", None] if field == "trade_date" else [datetime(2023, 1, 4), date(2023, 1, 4), True, None, *(["5000"] if field == "close" else [5000.0])]
    for n in (1000, 1001):
        for given in (values[:n], [*values[:n], *others, *values[:5]]):
            assert [r.ts_code for r in applied(rows, d, [P(field, "in", tuple(given))]).collect()] == ["000003.SH"]
    assert applied(rows, d, [P(field, "in", tuple(others * 500))]).count() == 0


def test_migration(spark):
    d = market_registry()["bars_1m"]
    old = spark.createDataFrame([("a", datetime(2024, 1, 2, 9, 31), float("nan"), 7.0, 5000.0)], "code string, datetime timestamp_ntz, open double, volume double, amount double")
    mapping = {k: v for k, v in old_mapping(d).items() if v[0] in old.columns}
    row = migrated(old, d, mapping).first()
    assert (row.ts_code, row.open, row.vol, row.amount, row.high) == ("a", None, 7.0, 5.0, None)


class Fake:
    def __init__(self, answer):
        self.answer, self.calls = answer, []

    def call(self, api, params=None, fields=""):
        self.calls.append(params)
        return self.answer(params)


def test_imports(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    names = ["ts_code", "list_status", "list_date"]
    given = {"L": [["600000.SH", "L", 19991110.0], ["600001.SH", "L", "1999-11-10"]], "D": [["600002.SH", "D", ""]], "P": [["600000.SH", "P", 0]]}
    fake = Fake(lambda p: remote.Page(names, given[p["list_status"]]))
    ingest.Importer(lake, fake).run(ingest.imports(2024)["stock_basic"])
    rows = {r.ts_code: (r.list_status, r.list_date) for r in lake.read("stock_basic").collect()}
    assert rows == {"600000.SH": ("L", date(1999, 11, 10)), "600001.SH": ("L", date(1999, 11, 10)), "600002.SH": ("D", None)}
    fake = Fake(lambda p: remote.Page(["ts_code", "name", "start_date"], [["a", "x", p["start_date"]]]))
    spec = ingest.imports(2024)["namechange"]
    importer = ingest.Importer(lake, fake)
    importer.run(spec, date(2024, 1, 1), date(2024, 2, 29))
    importer.run(spec, date(2024, 1, 1), date(2024, 2, 29))  # resumes after all of it
    assert lake.ledger("namechange").count() == 1 and lake.read("namechange").count() == 2 and len(importer.done("namechange")) == 2
    importer.run(spec, date(2024, 1, 1), date(2024, 5, 31), at_once=2)  # two of the three months left are one commit
    assert lake.ledger("namechange").count() == 3 and lake.read("namechange").count() == 5
    for _ in range(2):  # a snapshot replaces the one before
        ingest.Importer(lake, Fake(lambda p: remote.Page(names, given[p["list_status"]]))).run(ingest.imports(2024)["stock_basic"])
    assert lake.read("stock_basic").count() == 3 and {r.dataset: r.status for r in lake.verify().collect()}["stock_basic"] == "ok"
    for page_ in (remote.Page(["a"], [[1]], count=5000), remote.Page(["a"], [[1]] * 5, limit=5)):
        with pytest.raises(remote.SourceError):
            remote.complete(page_)


class Short:
    """A service with a row a day, of which it sends so many at most; ``told``: by its count, by its limit, or as a refusal."""

    def __init__(self, told, most=5):
        self.told, self.most = told, most

    def call(self, api, params=None, fields=""):
        a, b = (dates.date_parameter(params[k]) for k in ("start_date", "end_date"))
        rows = [["c", f"{a + timedelta(i):%Y%m%d}", str(n)] for i in range((b - a).days + 1) for n in range(3 if (a + timedelta(i)).day == 9 else 1)]
        sent = rows[: self.most]
        if self.told == "refusal" and len(rows) > self.most:
            raise remote.SourceError("response estimate: too large", "halve")
        return remote.Page(["ts_code", "trade_date", "vol"], sent, count=len(rows) if self.told == "count" else 0, limit=self.most + 1 if self.told == "limit" and len(rows) <= self.most else self.most if self.told == "limit" else 0)


@pytest.mark.parametrize("told", ["count", "limit", "refusal"])
def test_windows_that_are_too_large_are_halved(spark, tmp_path, told):
    lake = Lake(spark, str(tmp_path))
    spec = ingest.Import("index_daily", "window", "ts_code,trade_date,vol", ({"ts_code": "c"},), window_days=31)
    done = ingest.Importer(lake, Short(told)).run(spec, date(2024, 1, 5), date(2024, 3, 20))
    assert len(done) == 1 and done[0]["rows"] == 76
    # of the days that the service repeats, the first row stays
    assert sorted((r.trade_date, r.vol) for r in lake.read("index_daily").collect()) == [(date(2024, 1, 5) + timedelta(i), 0.0) for i in range(76)]
    pages = list(ingest.whole_pages(Short(told), "index_daily", {"start_date": "20240105", "end_date": "20240205"}, "ts_code,trade_date,vol"))
    days = [r[1] for p in pages for r in p.items]
    assert days == sorted(days) and len(set(days)) == 32 and all(len(p.items) <= 5 for p in pages)
    # one day alone can't be halved; nothing is committed then
    with pytest.raises(Exception, match="20240209"):
        ingest.Importer(lake, Short(told, 2)).run(spec, date(2024, 2, 8), date(2024, 2, 10))
    assert lake.version("index_daily") == 1


def test_sources(spark, monkeypatch):
    good = json.dumps({"code": 0, "data": {"fields": ["a"], "items": [[1]]}})
    asked = []

    def service(method, url, headers, body):
        asked.append(body["params"].get("limit"))
        if len(asked) < 3:
            raise remote.SourceError("too many rows", "halve")
        return good

    http = remote.Http("http://x", token="${SECRET}", limit=4000, tries=4, pause=0, transport=service)
    assert http.call("daily").items == [[1]] and asked == [4000, 4000, 2000]
    assert remote.envelope('[{"a": 1}, {"a": 2, "b": 3}]').items == [[1, None], [2, 3]]
    assert [remote.kind_of(*x) for x in ((400, "exceeds the limit"), (503, "too large"), (503, "down"), (429, ""), (404, "too large"), (200, "limit"))] == ["halve", "halve", "transient", "transient", "fatal", "fatal"]
    answers = [(503, '{"ok": false, "error": "busy"}'), (400, '{"code": 9, "msg": "no", "detail": "exceeds the limit"}'), (200, good)]
    assert remote.Http("http://x", pause=0, transport=lambda *a: answers.pop(0)).call("daily").items == [[1]]
    with pytest.raises(remote.SourceError, match="denied: ask first"):
        remote.Http("http://x", pause=0, transport=lambda *a: (200, '{"ok": false, "error": "denied", "message": "ask first"}')).call("daily")
    for bad in ('{"code": 1, "msg": "bad token"}', '{"data": {"fields": [], "items": [], "meta": {"sample": true}}}', '"x"'):
        with pytest.raises(remote.SourceError):
            remote.envelope(bad)

    def fails(params):
        raise remote.SourceError("down")

    first, second = Fake(fails), Fake(lambda p: remote.Page(["a"], [[2]]))
    assert remote.Fallback([first, second]).call("x").items == [[2]] and len(first.calls) == len(second.calls) == 1
    monkeypatch.setenv("SECRET", "s3")
    assert remote.expanded("x${SECRET}${UNSET}") == "xs3"
    found = remote.Sources({"sources": {"a": {"kind": "exec", "argv": ["true"]}, "b": {"kind": "nope"}, "c": {"kind": "http", "url": "u", "enabled": False}}, "bindings": {"d": ["b", "a"]}})
    assert found.resolve("d") is found.get("a") and "b" in found.broken and "c" not in found.made
    script = "import json,sys; p=json.load(sys.stdin)['params']; print(json.dumps({'fields': ['k', 'v'], 'items': [[p['k'], 1], [p['k'], None]]}))"
    spark.dataSource.register(remote.CallSource)
    source = json.dumps({"kind": "exec", "argv": ["python", "-c", script]})
    rows = spark.read.format("market_calls").option("source", source).option("api", "x").option("fields", "k,v").option("calls", json.dumps([{"k": "a"}, {"k": "b"}])).load()
    assert {(r.k, r.v) for r in rows.collect()} == {("a", "1"), ("a", None), ("b", "1"), ("b", None)}


def test_rounded_as_doubles(spark):
    from tidelake.functions.market import rounded

    got = spark.createDataFrame([(2384.865,), (-2384.865,), (0.5,), (1.005,), (None,)], "x double").select(rounded(F.col("x"), 2).alias("r"))
    assert [r.r for r in got.collect()] == [2384.86, -2384.86, 0.5, 1.0, None]
