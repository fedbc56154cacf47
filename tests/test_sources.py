"""CSV scans, bar rules, cleaning, landed payloads and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning as C, sets as U
from tidemark.sources import bars as B, feature_store as S, landed as L

D = dt.date
BARS = "symbol string, date date, open double, high double, low double, close double, volume long"


def csv(tmp_path, text, name="bars.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


HEADER = "symbol,timestamp,open,high,low,close,volume\n"


def test_reads_bars_in_any_column_order(spark, tmp_path):
    rows = "AAPL,2024-01-03,11,12,10,11.5,200\nAAPL,2024-01-02,10,11,9,10.5,100\n\n MSFT ,2024-01-02,20,21,19,20.5,300\n"
    got = B.read_bars_csv(spark, csv(tmp_path, HEADER + rows)).orderBy("symbol", "date").collect()
    assert [(r["symbol"], r["date"], r["close"], r["volume"]) for r in got] == [
        ("AAPL", D(2024, 1, 2), 10.5, 100), ("AAPL", D(2024, 1, 3), 11.5, 200), ("MSFT", D(2024, 1, 2), 20.5, 300)]
    other = " volume,close ,low,high,open,timestamp,symbol\n100,10.5,9,11,10,2024-01-02,A\n"
    row = B.read_bars_csv(spark, csv(tmp_path, other, "b.csv")).collect()[0]
    assert (row["open"], row["high"], row["low"], row["close"], row["volume"]) == (10.0, 11.0, 9.0, 10.5, 100)


def test_files_of_one_folder_have_headers_of_their_own(spark, tmp_path):
    csv(tmp_path, HEADER + "A,2024-01-02,10,20,5,15,100\n", "a.csv")
    csv(tmp_path, "symbol,timestamp,close,low,high,open,volume\nB,2024-01-02,15,5,20,10,100\n", "b.csv")
    got = B.read_bars_csv(spark, str(tmp_path)).orderBy("symbol").collect()
    assert [tuple(r) for r in got] == [(s, D(2024, 1, 2), 10.0, 20.0, 5.0, 15.0, 100) for s in "AB"]
    csv(tmp_path, "no,header,here\n", "c.csv")
    with pytest.raises(ValueError):
        B.read_bars_csv(spark, str(tmp_path))


def test_price_folder_refuses_bad_cells(spark, tmp_path):
    csv(tmp_path, "ts,open,high,low,close,volume\n2024-01-02,1,2,x,1,10\n", "Q_1d.csv")
    with pytest.raises(Exception):
        B.read_price_dir(spark, str(tmp_path)).collect()


def test_store_filters_reach_the_scan(spark, tmp_path):
    store = S.FeatureStore(spark, str(tmp_path / "fs"))
    for day in (1, 2, 3):
        store.add(spark.createDataFrame([(s, dt.datetime(2024, 1, day), "f", float(day), "x", "", dt.datetime(2024, 1, day)) for s in "AB"], S.FEATURE))
    for df in (store.query("A", dt.datetime(2024, 1, 2), ["f"]), store.query_range(["A"], ["f"], dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters"):]
        assert "symbol" in pushed.split("]")[0] and "ts_available" in pushed.split("]")[0]
    assert [r["feature_value"] for r in store.query("A", dt.datetime(2024, 1, 2), ["f"]).collect()] == [2.0]
    assert store.feature_names() == ["f"]


def test_rejects_bad_headers_and_values(spark, tmp_path):
    with pytest.raises(ValueError):
        B.read_bars_csv(spark, csv(tmp_path, "symbol,timestamp,open,high,low,close\nA,2024-01-02,1,1,1,1\n"))
    with pytest.raises(ValueError):
        B.read_bars_csv(spark, csv(tmp_path, HEADER.replace("volume", "vol") + "A,2024-01-02,1,1,1,1,1\n", "c.csv"))
    for i, bad in enumerate(("A,01/02/2024,1,1,1,1,1", "A,2024-01-02,x,1,1,1,1", "A,2024-01-02,1,1,1,1")):
        with pytest.raises(Exception):
            B.read_bars_csv(spark, csv(tmp_path, HEADER + bad + "\n", f"bad{i}.csv")).collect()


@pytest.mark.parametrize("row,rule", [
    (("A", D(2024, 1, 2), -1.0, 12.0, 9.0, 10.0, 1), "negative_ohlc"),
    (("A", D(2024, 1, 2), 10.0, 8.0, 9.0, 10.0, 1), "high_below_low"),
    (("A", D(2024, 1, 2), 12.0, 11.0, 9.0, 10.0, 1), "high_below_open"),
    (("A", D(2024, 1, 2), 10.0, 11.0, 9.0, 12.0, 1), "high_below_close"),
    (("A", D(2024, 1, 2), 8.0, 11.0, 9.0, 10.0, 1), "low_above_open"),
    (("A", D(2024, 1, 2), 10.0, 11.0, 9.0, 8.0, 1), "low_above_close"),
    (("A", D(2024, 1, 2), 10.0, 11.0, 9.0, 10.0, -1), "negative_volume"),
])
def test_bar_rules(spark, row, rule):
    good = ("B", D(2024, 1, 2), 10.0, 11.0, 9.0, 10.0, 1)
    df = spark.createDataFrame([row, good], BARS)
    report = C.validate_bars(df, "report").collect()
    assert [r["symbol"] for r in report] == ["A"] and rule in report[0]["violations"]
    assert [r["symbol"] for r in C.validate_bars(df, "drop").collect()] == ["B"]
    with pytest.raises(ValueError):
        C.validate_bars(df)
    assert C.validate_bars(df.filter("symbol = 'B'")).count() == 1


def test_duplicate_bars(spark):
    twice = spark.createDataFrame([("A", D(2024, 1, 2), 10.0, 11.0, 9.0, 10.0, 1)] * 2, BARS)
    assert [r["violations"] for r in C.validate_bars(twice, "report").collect()] == [["duplicate_timestamp"]] * 2


def bars20(spark):
    rows = [("A", D(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i, 103.0 + i, 97.0 + i, 101.0 + i, 500_000 + 35_000 * i)
            for i in range(20)]
    return spark.createDataFrame(rows, BARS)


def test_cleaning(spark):
    holed = bars20(spark).withColumn("close", F.when(~F.dayofmonth("date").isin(5, 10, 11, 12, 13), F.col("close"))) \
        .withColumn("volume", F.when(F.dayofmonth("date") != 7, F.col("volume")))
    got = {r["ts"].day: r for r in C.clean_ohlcv(holed).collect()}
    assert got[5]["close"] == 104.0 and got[12]["close"] == 109.0
    assert 13 not in got  # a fourth missing close is not filled
    assert got[7]["volume"] == 0 and got[1]["day_of_week"] == 1


def test_calendar_keeps_fridays(spark):
    rows = [("A", D(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 5), ("A", D(2024, 1, 5), 2.0, 2.0, 2.0, 2.0, 6),
            ("B", D(2024, 1, 6), 3.0, 3.0, 3.0, 3.0, 7)]
    df = spark.createDataFrame(rows, BARS).withColumnRenamed("date", "ts")
    got = C.align_to_calendar(df).orderBy("symbol", "ts").collect()
    assert [r["ts"].day for r in got] == [1, 2, 3, 4, 5, 6]
    assert [r["close"] for r in got] == [1.0, 1.0, 1.0, 1.0, 2.0, 3.0]
    assert [r["volume"] for r in got] == [5, 0, 0, 0, 6, 7]


def test_splits_and_volume(spark):
    df = bars20(spark).withColumn("close", F.when(F.dayofmonth("date") >= 11, F.col("close") / 3.2).otherwise(F.col("close")))
    split = C.detect_splits(df).collect()
    assert [(r["date"].day, r["ratio_suspected"]) for r in split] == [(11, "1:3")]
    z = C.normalize_volume(bars20(spark)).agg(F.avg("volume_z"), F.stddev_samp("volume_z")).collect()[0]
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)
    flat = C.normalize_volume(bars20(spark).withColumn("volume", F.lit(7))).select("volume_z").distinct().collect()
    assert flat[0][0] == 0.0


def test_write_and_read_universe(spark, tmp_path):
    B.write_bars(bars20(spark), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("symbol = 'A'").count() == 20
    one = tmp_path / "prices"
    one.mkdir()
    (one / "QQ_1d.csv").write_text("ts,open,high,low,close,volume\n2024-01-02 00:00:00,1,2,0.5,1.5,10\n")
    (one / "skip.csv").write_text("x\n1\n")
    row = B.read_price_dir(spark, str(one)).collect()
    assert len(row) == 1 and row[0]["symbol"] == "QQ" and row[0]["volume"] == 10 and row[0]["date"] == D(2024, 1, 2)


def test_time_bounds(spark):
    row = B.time_bounds(bars20(spark)).collect()[0]
    assert row["earliest"] == 1704067200 * 10**9
    assert B.time_bounds(bars20(spark).limit(0)).collect()[0][:] == (0, 0)
    assert B.bars_in_range(bars20(spark), "2024-01-03", "2024-01-05").count() == 3


def docs(spark, **fields):
    return spark.createDataFrame([tuple(fields.values())], list(fields))


def test_macro_payload(spark):
    payload = json.dumps({"title": "T", "observations": [{"date": "2024-01-01", "value": "1.5"},
                                                         {"date": "2024-02-01", "value": "."},
                                                         {"date": "2024-03-01", "value": "abc"}]})
    rows = L.macro_observations(docs(spark, series_id="X", payload=payload)).collect()
    assert [(r["date"], r["value"], r["name"], r["units"]) for r in rows] == [(D(2024, 1, 1), 1.5, "T", "")]


def test_company_payloads(spark):
    entry = lambda **k: {"val": 5, "fy": 2023, "fp": "Q1", "filed": "2023-05-01", "form": "10-Q", "start": "2023-01-01",
                         "end": "2023-03-31", **k}
    facts = json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [entry()]}}, "Other": {"units": {"USD": [entry()]}}}}})
    assert [r["metric"] for r in L.xbrl_metrics(docs(spark, cik="1", payload=facts)).collect()] == ["TotalAssets"]
    shares = json.dumps({"units": {"shares": [entry(val=1), entry(val=2), entry(val=None), entry(filed="2023-08-01", val=3)]}})
    got = L.shares_outstanding(docs(spark, symbol="A", payload=shares)).orderBy("ts_available").collect()
    assert [r["shares"] for r in got] == [2.0, 3.0]
    rows = [("A", "SalesRevenueNet", [entry(val=1)]), ("A", "Revenues", [entry(val=2), entry(form="8-K"), entry(start=None)]),
            ("A", "RevenueFromContractWithCustomerExcludingAssessedTax", [])]
    df = spark.createDataFrame([(s, t, json.dumps({"units": {"USD": e}})) for s, t, e in rows], "symbol string, tag string, payload string")
    assert [r["val"] for r in L.revenue_rows(df).collect()] == [2.0]


def test_filings_payload(spark):
    recent = {"accessionNumber": ["1-2", "3-4"], "filingDate": ["2024-01-01", "2024-02-01"], "form": ["4", "10-K"],
              "primaryDocument": ["a.xml", "b.htm"], "reportDate": ["", ""], "primaryDocDescription": ["", "K"]}
    history = L.filing_history(docs(spark, cik="77", payload=json.dumps({"filings": {"recent": recent}})))
    assert history.count() == 2
    row = L.insider_filings(history).collect()
    assert len(row) == 1 and row[0]["document_url"].endswith("/77/12/a.xml")


def test_award_job_chart_payloads(spark):
    awards = json.dumps({"results": [{"Award ID": "a", "Award Amount": 5.5, "Start Date": "2024-01-02"},
                                     {"Award ID": "b", "Award Amount": "junk"}, {"Award ID": "c"}]})
    got = {r["award_id"]: r["amount"] for r in L.award_rows(docs(spark, vendor="V", payload=awards)).collect()}
    assert got == {"a": 5.5, "b": 0.0, "c": 0.0}
    months = json.dumps({"results": [{"time_period": {"fiscal_year": "2024", "month": "1"}, "aggregated_amount": 7},
                                     {"time_period": {"fiscal_year": "2024", "month": "5"}, "aggregated_amount": None},
                                     {"time_period": {"fiscal_year": "x", "month": "5"}, "aggregated_amount": 1}]})
    got = L.monthly_obligations(docs(spark, vendor="V", payload=months)).orderBy("month").collect()
    assert [(r["month"], r["amount"]) for r in got] == [(D(2023, 10, 31), 7.0), (D(2024, 2, 29), 0.0)]
    item = {"MatchedObjectDescriptor": {
        "PositionTitle": "T", "PublicationStartDate": "2026-05-26T00:00:00.0000",
        "PositionRemuneration": [{"MinimumRange": "$1,234.50", "MaximumRange": ""}],
        "PositionFormattedDescription": [{"Label": "Duties Summary", "Value": "x" * 600}, {"Label": "Z", "Value": "n"}]}}
    job = L.job_rows(docs(spark, keyword="k", payload=json.dumps({"SearchResult": {"SearchResultItems": [item]}}))).collect()[0]
    assert (job["salary_min"], job["salary_max"], len(job["description"]), job["post_date"]) == (1234.5, 0.0, 600, D(2026, 5, 26))
    chart = {"chart": {"result": [{"timestamp": [0, 86400], "indicators": {"quote": [
        {"open": [1.0, None], "high": [2.0, 2.0], "low": [0.5, 1.0], "close": [1.5, 1.0], "volume": [3, 4]}]}}]}}
    got = L.chart_bars(docs(spark, symbol="A", payload=json.dumps(chart))).collect()
    assert len(got) == 1 and got[0]["volume"] == 3


def test_otc_file(spark, tmp_path):
    text = "tradeDate,issueSymbolIdentifier,totalWeeklyShareQuantity,totalWeeklyTradeCount,tier,numberOfMarketMakers,lastSalePrice\n" \
           "2024-01-01,AAA,100,NULL,T1,5,1.5\n2024-02-01,BBB, ,7,T2,,2.5\n"
    df = L.otc_weekly(spark, csv(tmp_path, text, "otc.csv"))
    assert df.columns == ["trade_date", "ticker", "share_volume", "trade_count", "tier", "market_makers", "avg_price"]
    rows = df.orderBy("ticker").collect()
    assert rows[0]["trade_count"] is None and rows[1]["share_volume"] is None and rows[1]["trade_count"] == 7
    assert L.otc_weekly(spark, csv(tmp_path, text, "otc2.csv"), start="2024-01-15").count() == 1
    assert L.otc_weekly(spark, csv(tmp_path, text, "otc3.csv"), tier="T1").count() == 1


def test_sets(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2.5, D(2024, 1, 1))], "k double, d date")
    rows = U.union_relaxed(a, b).orderBy("k").collect()
    assert [(r["k"], r["s"], r["d"]) for r in rows] == [(1.0, "x", None), (2.5, None, D(2024, 1, 1))]
    df = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("b", 1, "r")], "k string, o int, v string")
    assert {r["v"] for r in U.keep_last(df, ["k"], ["o"]).collect()} == {"q", "r"}
    assert {r["v"] for r in U.first_by(df, ["k"], ["o"]).collect()} == {"p", "r"}
    assert {r["v"] for r in U.last_n(df, ["k"], ["o"], 1).collect()} == {"q", "r"}
