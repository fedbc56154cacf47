"""Readers and sinks: files and payloads are landed from the given tables first."""

from pyspark.sql import functions as F

from catalog.base import (awards, bars, fills, jobs, macro, otc, query, revenue, shared_folder, shares,
                          transactions, ubars)
from catalog.windows import MOM, panel
from tidemark.operators import trades as T
from tidemark.plans.study import signal_study
from tidemark.sources import bars as B, landed as L


def _docs(df, key, payload):
    return df.select(*key, F.to_json(payload).alias("payload"))


@query("s1_read_bars_csv", "select * from bars", ("bars",))
def s1(spark, sf):
    folder = shared_folder(spark, "bars-csv")
    bars(spark, sf).select("volume", "symbol", F.col("date").alias("timestamp"), "low", "high", "open", "close") \
        .write.option("header", True).csv(folder)
    return B.read_bars_csv(spark, folder)


def _one_file_per_symbol(spark, df, folder):
    """Land ``<symbol>_1d.csv`` files, as a download job leaves them."""
    df.repartition("sym").sortWithinPartitions("sym").write.partitionBy("sym").option("header", True).csv(folder + "-raw")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for part in fs.globStatus(path(f"{folder}-raw/sym=*/part-*.csv")):
        symbol = part.getPath().getParent().getName().split("=")[1]
        fs.rename(part.getPath(), path(f"{folder}/{symbol}_1d.csv"))


@query("s3_read_price_dir", "select * from bars", ("bars",))
def s3(spark, sf):
    folder = shared_folder(spark, "prices")
    rows = bars(spark, sf).select(F.col("symbol").alias("sym"), F.col("date").cast("timestamp").alias("ts"), "open",
                                  "high", "low", "close", "volume")
    _one_file_per_symbol(spark, rows, folder)
    return B.read_price_dir(spark, folder)


@query("s6_write_bars_parquet", "select cast(date as varchar) ts, open, high, low, close, volume, symbol from bars", ("bars",))
def s6(spark, sf):
    folder = shared_folder(spark, "bars-parquet")
    B.write_bars(bars(spark, sf), folder)
    return spark.read.parquet(folder).withColumn("symbol", F.col("symbol").cast("string"))


@query("s6_write_bars_csv", "select cast(date as varchar) ts, open, high, low, close, volume, symbol from bars", ("bars",))
def s6_csv(spark, sf):
    folder = shared_folder(spark, "bars-out-csv")
    B.write_bars(bars(spark, sf), folder, "csv")
    return spark.read.schema("ts string, open double, high double, low double, close double, volume bigint, symbol string") \
        .option("header", True).csv(folder)


@query("s12_save_study", "select quantile::bigint quantile, count(*) total_count from study_rows group by 1", ("study_rows",))
def s12(spark, sf):
    folder = shared_folder(spark, "study")
    B.save_study(signal_study(panel(spark, sf), MOM, "forward_4d_return"), folder)
    return spark.read.json(f"{folder}/quintile_summary").select("quantile", "total_count")


@query("s13_write_run", """select order_id, symbol, side, price, quantity, commission from fills""", ("fills",))
def s13(spark, sf):
    folder = shared_folder(spark, "run")
    f = fills(spark, sf).withColumn("slippage_bps", F.lit(0.0))
    curve = T.equity_curve(f, ubars(spark, sf))
    B.write_run(f, curve, T.max_drawdown_pct(curve), folder)
    schema = ("order_id bigint, symbol string, side string, price double, quantity bigint, timestamp timestamp, "
              "commission double, slippage_bps double")
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/trades") \
        .select("order_id", "symbol", "side", "price", "quantity", "commission")


def _entry():
    return F.struct(F.col("val"), F.col("fy"), F.col("fp"), F.col("filed").cast("string").alias("filed"), "form",
                    F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


@query("s14_xbrl_metrics", """select symbol cik, 'Revenue' metric, val as value, fy, fp, filed::varchar filed, form, 'USD' unit from revenue union all
    select symbol, 'TotalAssets', val, fy, fp, filed::varchar, form, 'USD' from revenue""", ("revenue",), {"value": 2})
def s14(spark, sf):
    # One document per symbol; a symbol has one entry per quarter.
    grouped = revenue(spark, sf).groupBy("symbol").agg(F.collect_list(_entry()).alias("e"))
    concept = F.struct(F.struct(F.col("e").alias("USD")).alias("units"))
    tags = F.create_map(F.lit("Revenues"), concept, F.lit("Assets"), concept, F.lit("SomethingElse"), concept)
    payload = F.struct(F.struct(tags.alias("us-gaap")).alias("facts"))
    return L.xbrl_metrics(_docs(grouped, [F.col("symbol").alias("cik")], payload))


def _submissions(spark, sf):
    arr = lambda c: F.transform("r", lambda x: x[c])
    rows = revenue(spark, sf).select("symbol", F.struct(
        F.concat_ws("-", "symbol", F.col("end").cast("string")).alias("a"), F.col("filed").cast("string").alias("f"),
        F.col("end").cast("string").alias("e"), F.when(F.col("fp") == "Q1", "4").otherwise("10-Q").alias("form"),
        F.concat("fp", F.lit(".htm")).alias("p"), F.lit("quarterly").alias("d")).alias("s"))
    grouped = rows.groupBy("symbol").agg(F.array_sort(F.collect_list("s")).alias("r"))
    recent = F.struct(arr("a").alias("accessionNumber"), arr("f").alias("filingDate"), arr("e").alias("reportDate"),
                      arr("form").alias("form"), arr("p").alias("primaryDocument"), arr("d").alias("primaryDocDescription"))
    return _docs(grouped, [F.col("symbol").alias("cik")], F.struct(F.struct(recent.alias("recent")).alias("filings")))


@query("s15_filing_history", """select symbol cik, symbol||'-'||"end" accession, filed::varchar filing_date, "end"::varchar report_date,
    case when fp='Q1' then '4' else '10-Q' end form, fp||'.htm' primary_document, 'quarterly' description from revenue""", ("revenue",))
def s15(spark, sf):
    return L.filing_history(_submissions(spark, sf))


@query("s15_insider_filings", """select symbol||'-'||"end" accession, filed::varchar filing_date, symbol issuer_cik,
    'https://www.sec.gov/Archives/edgar/data/'||symbol||'/'||replace(symbol||'-'||"end", '-', '')||'/'||fp||'.htm' document_url
    from revenue where fp='Q1'""", ("revenue",))
def s15_insider(spark, sf):
    return L.insider_filings(L.filing_history(_submissions(spark, sf)))


@query("s16_shares_outstanding", """select symbol, ts_available, shares+1 shares from shares""", ("shares",))
def s16(spark, sf):
    day = F.date_format("ts_available", "yyyy-MM-dd")
    # Every date is reported twice; the later entry counts.
    twice = F.array(F.struct(day.alias("filed"), F.col("shares").alias("val")),
                    F.struct(day.alias("filed"), (F.col("shares") + 1).alias("val")),
                    F.struct(F.lit(None).cast("string").alias("filed"), F.lit(5.0).alias("val")))
    grouped = shares(spark, sf).select("symbol", twice.alias("t")).groupBy("symbol").agg(F.collect_list("t").alias("l"))
    payload = F.struct(F.struct(F.flatten("l").alias("shares")).alias("units"))
    return L.shares_outstanding(_docs(grouped, ["symbol"], payload))


@query("s17_revenue_rows", """select symbol, start::varchar "start", "end"::varchar "end", val, fy, fp, filed::varchar filed, form from revenue""",
       ("revenue",), {"val": 2})
def s17(spark, sf):
    grouped = revenue(spark, sf).groupBy("symbol").agg(F.collect_list(_entry()).alias("e"))
    full = grouped.select("symbol", F.lit("Revenues").alias("tag"), "e")
    empty = grouped.select("symbol", F.lit("RevenueFromContractWithCustomerExcludingAssessedTax").alias("tag"),
                           F.slice("e", 1, 0).alias("e"))
    worse = grouped.select("symbol", F.lit("SalesRevenueNet").alias("tag"), F.slice("e", 1, 1).alias("e"))
    docs = full.unionByName(empty).unionByName(worse)
    return L.revenue_rows(_docs(docs, ["symbol", "tag"], F.struct(F.struct(F.col("e").alias("USD")).alias("units"))))


@query("s18_macro_observations", """select date, value, series_id, 'Series '||series_id as "name", 'USD' units from macro where month(date)<>3
    and date<=date '1999-12-31'""", ("macro",), {"value": 4})
def s18(spark, sf):
    value = F.when(F.month("date") == 3, F.lit(".")).otherwise(F.col("value").cast("string"))
    obs = F.struct(F.col("date").cast("string").alias("date"), value.alias("value"))
    grouped = macro(spark, sf).groupBy("series_id").agg(F.collect_list(obs).alias("observations"))
    payload = F.struct(F.concat(F.lit("Series "), "series_id").alias("title"), F.lit("USD").alias("units"), "observations")
    return L.macro_observations(_docs(grouped, ["series_id"], payload), end="1999-12-31")


@query("s19_award_rows", """select symbol vendor, award_id, 'Agency' agency, case when cast(award_id as bigint)%10=0 then 0 else amount end amount,
    event_date start_date from awards""", ("awards",), {"amount": 2})
def s19(spark, sf):
    amount = F.when(F.col("award_id").cast("long") % 10 == 0, F.lit("n/a")).otherwise(F.col("amount").cast("string"))
    one = F.struct(F.col("award_id").alias("Award ID"), F.lit("Agency").alias("Awarding Agency"),
                   amount.alias("Award Amount"), F.col("event_date").cast("string").alias("Start Date"))
    docs = _docs(awards(spark, sf), [F.col("symbol").alias("vendor")], F.struct(F.array(one).alias("results")))
    return L.award_rows(docs).select("vendor", "award_id", "agency", "amount", "start_date")


@query("s19_transaction_rows", """select symbol vendor, award_id, amount, action_date::varchar action_date from transactions""",
       ("transactions",), {"amount": 2})
def s19_tx(spark, sf):
    one = F.struct(F.col("award_id").alias("Award ID"), F.col("amount").alias("Transaction Amount"),
                   F.col("action_date").cast("string").alias("Action Date"))
    docs = _docs(transactions(spark, sf), [F.col("symbol").alias("vendor")], F.struct(F.array(one).alias("results")))
    return L.transaction_rows(docs).select("vendor", "award_id", "amount", "action_date")


@query("s20_monthly_obligations", """select symbol vendor, last_day(action_date) "month", sum(amount) amount from transactions group by 1,2""",
       ("transactions",), {"amount": 2})
def s20_rows(spark, sf):
    day = F.col("action_date")
    monthly = transactions(spark, sf).groupBy(
        "symbol", (F.year(day) + (F.month(day) >= 10).cast("int")).alias("fy"),
        ((F.month(day) + 2) % 12 + 1).alias("fm")).agg(F.sum("amount").alias("amount"))
    one = F.struct(F.struct(F.col("fy").cast("string").alias("fiscal_year"), F.col("fm").cast("string").alias("month"))
                   .alias("time_period"), F.col("amount").alias("aggregated_amount"))
    grouped = monthly.groupBy("symbol").agg(F.collect_list(one).alias("results"))
    return L.monthly_obligations(_docs(grouped, [F.col("symbol").alias("vendor")], F.struct("results")))


@query("s21_job_rows", """select agency, post_date, description, length(description)*1000.5 salary_min, 0.0::double salary_max,
    'kw' keyword from jobs""", ("jobs",), {"salary_min": 2, "salary_max": 2})
def s21(spark, sf):
    pay = F.struct(F.concat(F.lit("$"), F.format_number(F.length("description") * F.lit(1000.5), 1)).alias("MinimumRange"),
                   F.lit("").alias("MaximumRange"))
    parts = F.array(F.struct(F.lit("Other").alias("Label"), F.lit("ignored").alias("Value")),
                    F.struct(F.lit("Duties Summary").alias("Label"), F.col("description").alias("Value")))
    m = F.struct(F.col("agency").alias("DepartmentName"), parts.alias("PositionFormattedDescription"),
                 F.concat(F.col("post_date").cast("string"), F.lit("T00:00:00.0000")).alias("PublicationStartDate"),
                 F.array(pay).alias("PositionRemuneration"))
    items = F.struct(F.array(F.struct(m.alias("MatchedObjectDescriptor"))).alias("SearchResultItems"))
    docs = _docs(jobs(spark, sf), [F.lit("kw").alias("keyword")], F.struct(items.alias("SearchResult")))
    return L.job_rows(docs).select("agency", "post_date", "description", "salary_min", "salary_max", "keyword")


@query("s22_chart_bars", """select symbol, date::timestamp ts, open, high, low, close, volume from bars where volume%6<>0""", ("bars",))
def s22(spark, sf):
    row = F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("t"), "open", "high", "low",
                   F.when(F.col("volume") % 6 != 0, F.col("close")).alias("close"), "volume")
    # One chart document per symbol: at most one bar per calendar week.
    grouped = bars(spark, sf).groupBy("symbol").agg(F.array_sort(F.collect_list(row)).alias("r"))
    arr = lambda c: F.transform("r", lambda x: x[c])
    quote = F.struct(*[arr(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    result = F.struct(arr("t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    payload = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return L.chart_bars(grouped.select("symbol", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload")))


@query("s23_otc_weekly", """select trade_date, ticker, case when ticker<'T25' then 'T1' else 'T2' end tier, share_volume, case when trade_count%5=0
    then null else trade_count end trade_count, market_makers from otc where trade_date>=date '1996-01-01' and ticker<'T25'""", ("otc",))
def s23(spark, sf):
    folder = shared_folder(spark, "otc")
    count = F.when(F.col("trade_count") % 5 != 0, F.col("trade_count").cast("string")).otherwise("NULL")
    otc(spark, sf).select(
        F.col("trade_date").alias("tradeDate"), F.col("ticker").alias("issueSymbolIdentifier"),
        F.when(F.col("ticker") < "T25", "T1").otherwise("T2").alias("tier"),
        F.col("share_volume").alias("totalWeeklyShareQuantity"), count.alias("totalWeeklyTradeCount"),
        F.col("market_makers").alias("numberOfMarketMakers"),
    ).write.option("header", True).option("sep", "\t").csv(folder)
    return L.otc_weekly(spark, folder, start="1996-01-01", tier="T1")
