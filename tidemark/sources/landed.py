"""Landed JSON and CSV payloads to typed tables.

Every reader takes a table with the raw payload in a string column (one document
per row, as ``spark.read.text(..., wholetext=True)`` or a landing job delivers
it) next to its identifying columns, and flattens it with a fixed schema.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.columns import fiscal_month_end, lenient_date
from tidemark.functions.vocabularies import OTC_WORDS, REVENUE_TAGS, XBRL_TAGS
from tidemark.operators.sets import keep_last, top_n

_FACT = "struct<val:double,fy:int,fp:string,filed:string,form:string,start:string,end:string>"
_CONCEPT = f"struct<units:map<string,array<{_FACT}>>>"


def _number(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def xbrl_metrics(docs: DataFrame, tags: dict[str, str] = XBRL_TAGS, payload: str = "payload",
                 cik: str = "cik") -> DataFrame:
    """Company facts to one row per reported value of the wanted tags."""
    schema = f"struct<facts:struct<`us-gaap`:map<string,{_CONCEPT}>>>"
    labels = F.create_map(*[F.lit(x) for label, tag in tags.items() for x in (tag, label)])
    concepts = docs.select(cik, F.explode(F.from_json(payload, schema)["facts"]["us-gaap"]).alias("tag", "concept"))
    units = concepts.filter(F.col("tag").isin(list(tags.values()))).select(
        cik, labels[F.col("tag")].alias("metric"), F.explode("concept.units").alias("unit", "entries"))
    return units.select(cik, "metric", "unit", F.inline("entries")).select(
        cik, "metric", F.col("val").alias("value"), "fy", "fp", "filed", "form", "unit")


def filing_history(docs: DataFrame, payload: str = "payload", cik: str = "cik") -> DataFrame:
    """Submission arrays to one row per filing."""
    fields = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument", "primaryDocDescription")
    schema = "struct<filings:struct<recent:struct<" + ",".join(f"{f}:array<string>" for f in fields) + ">>>"
    recent = docs.select(cik, F.from_json(payload, schema)["filings"]["recent"].alias("r"))
    rows = recent.select(cik, F.inline(F.arrays_zip(*[F.col(f"r.{f}").alias(f) for f in fields])))
    return rows.select(
        cik, F.col("accessionNumber").alias("accession"), F.col("filingDate").alias("filing_date"),
        F.coalesce("reportDate", F.lit("")).alias("report_date"), "form",
        F.col("primaryDocument").alias("primary_document"),
        F.coalesce("primaryDocDescription", F.lit("")).alias("description"))


def insider_filings(history: DataFrame, cik: str = "cik") -> DataFrame:
    """Form 4 filings with the address of their document."""
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col(cik).cast("string"), F.lit("/"),
                   F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"), F.col("primary_document"))
    return history.filter(F.col("form") == "4").select(
        "accession", "filing_date", F.col(cik).alias("issuer_cik"), url.alias("document_url"))


def shares_outstanding(docs: DataFrame, payload: str = "payload", symbol: str = "symbol") -> DataFrame:
    """Share counts by filing date; the last reported value of a date counts."""
    schema = f"struct<units:struct<shares:array<{_FACT}>>>"
    parsed = docs.select(symbol, F.posexplode(F.from_json(payload, schema)["units"]["shares"]).alias("_pos", "e"))
    rows = parsed.filter("e.filed is not null and e.filed <> '' and e.val is not null and e.val <> 0").select(
        F.col(symbol).alias("symbol"), F.to_timestamp("e.filed", "yyyy-MM-dd").alias("ts_available"),
        F.col("e.val").alias("shares"), "_pos")
    return keep_last(rows, ["symbol", "ts_available"], ["_pos"]).select("symbol", "ts_available", "shares")


def revenue_rows(docs: DataFrame, tags: Sequence[str] = REVENUE_TAGS, payload: str = "payload",
                 symbol: str = "symbol", tag: str = "tag") -> DataFrame:
    """Quarterly and annual revenue entries of each symbol's preferred non-empty tag."""
    rank = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col(tag))
    units = F.from_json(payload, f"struct<units:struct<USD:array<{_FACT}>>>")["units"]["USD"]
    ranked = docs.select(symbol, rank.alias("_rank"), units.alias("_e")).filter("_rank > 0 and size(_e) > 0")
    best = ranked.groupBy(symbol).agg(F.min("_rank").alias("_rank"))
    rows = ranked.join(best, [symbol, "_rank"], "left_semi").select(symbol, F.inline("_e"))
    present = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("start", "end", "filed")]
    return rows.filter(F.col("form").isin("10-Q", "10-K") & present[0] & present[1] & present[2]).select(
        F.col(symbol).alias("symbol"), "start", "end", F.coalesce("val", F.lit(0.0)).alias("val"), "fy", "fp",
        "filed", "form")


def macro_observations(docs: DataFrame, start: str | None = None, end: str | None = None,
                       payload: str = "payload", series_id: str = "series_id") -> DataFrame:
    """Series payloads to dated values; ``.`` and other non-numbers are missing."""
    schema = "struct<title:string,units:string,observations:array<struct<date:string,value:string>>>"
    parsed = docs.select(series_id, F.from_json(payload, schema).alias("d"))
    rows = parsed.select(series_id, "d.title", "d.units", F.inline("d.observations")).select(
        lenient_date("date").alias("date"), F.col("value").try_cast("double").alias("value"),
        F.col(series_id).alias("series_id"), F.coalesce("title", F.col(series_id)).alias("name"),
        F.coalesce("units", F.lit("")).alias("units")).filter("value is not null and not isnan(value)")
    if start:
        rows = rows.filter(F.col("date") >= F.to_date(F.lit(start)))
    return rows.filter(F.col("date") <= F.to_date(F.lit(end))) if end else rows


def _results(docs: DataFrame, fields: dict[str, str], keep: Sequence[str], payload: str) -> DataFrame:
    inner = ",".join(f"`{f}`:{t}" for f, t in fields.items())
    parsed = F.from_json(payload, f"struct<results:array<struct<{inner}>>>")["results"]
    return docs.select(*keep, F.inline(parsed))


def award_rows(docs: DataFrame, payload: str = "payload", vendor: str = "vendor") -> DataFrame:
    """Award search results; unreadable amounts count as 0."""
    names = ("Award ID", "Awarding Agency", "Awarding Sub Agency", "Recipient Name", "Recipient UEI", "Description",
             "Award Amount", "Potential Award Value", "Start Date", "End Date", "NAICS Description",
             "Product Service Code (PSC) Description")
    rows = _results(docs, {n: "string" for n in names}, [vendor], payload)
    c = lambda n: F.col(f"`{n}`")
    return rows.select(
        F.col(vendor).alias("vendor"), c("Award ID").alias("award_id"), c("Awarding Agency").alias("agency"),
        c("Awarding Sub Agency").alias("sub_agency"), c("Recipient Name").alias("vendor_name"),
        c("Recipient UEI").alias("vendor_uei"), c("Description").alias("description"),
        _number(c("Award Amount")).alias("amount"), _number(c("Potential Award Value")).alias("potential_value"),
        lenient_date(c("Start Date")).alias("start_date"), lenient_date(c("End Date")).alias("end_date"),
        c("NAICS Description").alias("naics"), c("Product Service Code (PSC) Description").alias("psc"))


def transaction_rows(docs: DataFrame, payload: str = "payload", vendor: str = "vendor") -> DataFrame:
    """Transaction search results; unreadable amounts count as 0."""
    names = ("Recipient Name", "Award ID", "Transaction Amount", "Action Date", "Awarding Agency")
    rows = _results(docs, {n: "string" for n in names}, [vendor], payload)
    text = lambda n: F.coalesce(F.col(f"`{n}`"), F.lit(""))
    return rows.select(
        F.col(vendor).alias("vendor"), text("Recipient Name").alias("recipient_name"),
        text("Award ID").alias("award_id"), _number(F.col("`Transaction Amount`")).alias("amount"),
        F.col("`Action Date`").alias("action_date"), text("Awarding Agency").alias("agency"))


def top_awards(rows: DataFrame, n: int = 150, vendor: str = "vendor") -> DataFrame:
    """The n largest rows of each vendor."""
    return top_n(rows, [vendor], [F.col("amount").desc(), F.col("award_id"), F.col("action_date")], n)


def monthly_obligations(docs: DataFrame, payload: str = "payload", vendor: str = "vendor") -> DataFrame:
    """Fiscal-month totals to calendar month ends; unreadable rows are skipped."""
    fields = {"time_period": "struct<fiscal_year:string,month:string>", "aggregated_amount": "string"}
    rows = _results(docs, fields, [vendor], payload).select(
        F.col(vendor).alias("vendor"), F.col("time_period.fiscal_year").try_cast("int").alias("fy"),
        F.col("time_period.month").try_cast("int").alias("fm"),
        F.when(F.coalesce("aggregated_amount", F.lit("")) == "", F.lit(0.0))
        .otherwise(F.col("aggregated_amount").try_cast("double")).alias("amount"))
    good = rows.filter("fy is not null and fm between 1 and 12 and amount is not null")
    return good.select("vendor", fiscal_month_end("fy", "fm").alias("month"), "amount")


def job_rows(docs: DataFrame, payload: str = "payload", keyword: str = "keyword") -> DataFrame:
    """Job search results with plain-number salaries and the duties text."""
    item = ("struct<MatchedObjectDescriptor:struct<PositionTitle:string,DepartmentName:string,"
            "PositionLocationDisplay:string,PublicationStartDate:string,ApplicationCloseDate:string,"
            "PositionRemuneration:array<struct<MinimumRange:string,MaximumRange:string>>,"
            "PositionFormattedDescription:array<struct<Label:string,Value:string>>>>")
    schema = f"struct<SearchResult:struct<SearchResultItems:array<{item}>>>"
    items = docs.select(keyword, F.explode(F.from_json(payload, schema)["SearchResult"]["SearchResultItems"]).alias("i"))
    m = items.select(keyword, "i.MatchedObjectDescriptor.*")
    duties = F.transform(F.filter("PositionFormattedDescription", lambda p: p["Label"] == "Duties Summary"),
                         lambda p: F.coalesce(p["Value"], F.lit("")))
    pay = lambda f: F.coalesce(F.regexp_replace(F.get("PositionRemuneration", F.lit(0))[f], r"[$,]", "")
                               .try_cast("double"), F.lit(0.0))
    text = lambda c: F.coalesce(c, F.lit(""))
    return m.select(
        text("PositionTitle").alias("job_title"), text("DepartmentName").alias("agency"),
        text("PositionLocationDisplay").alias("location"), lenient_date("PublicationStartDate").alias("post_date"),
        text("ApplicationCloseDate").alias("close_date"), pay("MinimumRange").alias("salary_min"),
        pay("MaximumRange").alias("salary_max"),
        F.coalesce(F.array_join(duties, " "), F.lit("")).alias("description"),
        F.col(keyword).alias("keyword"))


def chart_bars(docs: DataFrame, payload: str = "payload", symbol: str = "symbol") -> DataFrame:
    """Chart payload arrays to bars; rows without a full quote are dropped."""
    quote = "struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>"
    schema = f"struct<chart:struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<{quote}>>>>>>"
    first = F.get(F.from_json(payload, schema)["chart"]["result"], F.lit(0))
    parts = docs.select(symbol, first["timestamp"].alias("t"), F.get(first["indicators"]["quote"], F.lit(0)).alias("q"))
    zipped = F.arrays_zip(F.col("t").alias("t"), *[F.col(f"q.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    rows = parts.select(symbol, F.inline(zipped))
    return rows.select(F.col(symbol).alias("symbol"), F.timestamp_seconds("t").alias("ts"), "open", "high", "low",
                       "close", "volume").dropna(subset=["open", "high", "low", "close"])


def otc_column(name: str) -> str:
    """Standard name of an OTC file column, by the words its name holds; names that fit none stay."""
    plain = re.sub(r"[^a-z]", "", name.lower())
    fits = (target for target, choices in OTC_WORDS.items() for words in choices if all(w in plain for w in words))
    return next(fits, name)


def otc_weekly(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
               tier: str | None = None) -> DataFrame:
    """Weekly OTC file, tab- or comma-separated, with standard column names."""
    first = spark.read.text(path).limit(1).collect()
    sep = "\t" if first and "\t" in first[0]["value"] else ","
    options = {"header": True, "sep": sep, "nullValue": "NULL", "emptyValue": ""}
    named = spark.read.options(**options).csv(path).schema
    # With a schema given and not enforced, a file with another header fails the job instead of shifting columns.
    raw = spark.read.options(**options, enforceSchema=False, mode="FAILFAST").schema(named).csv(path)
    blank = [F.when(F.trim(F.col(f"`{c}`")) == "", None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns]
    taken: set[str] = set()
    names = []
    for c in raw.columns:
        target = otc_column(c)
        names.append(target if target not in taken else c)
        taken.add(target)
    df = raw.select(*blank).toDF(*names)
    types = {"trade_date": "date", "share_volume": "double", "trade_count": "long", "market_makers": "long",
             "avg_price": "double"}
    df = df.withColumns({c: lenient_date(c) if t == "date" else F.col(c).try_cast(t)
                         for c, t in types.items() if c in df.columns})
    if start and "trade_date" in df.columns:
        df = df.filter(F.col("trade_date") >= F.to_date(F.lit(start)))
    if end and "trade_date" in df.columns:
        df = df.filter(F.col("trade_date") <= F.to_date(F.lit(end)))
    if tier and "tier" in df.columns:
        df = df.filter(F.col("tier").contains(tier))
    return df
