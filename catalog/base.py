"""Registry, rounding and the views both engines share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import ensure_checkpoint_dir

# Added on both sides before rounding, so that exact halves (means of cents) do
# not fall either way with the order of summation.
NUDGE = 0.0037

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), floats: dict[str, int] | None = None):
    """Register a query. ``floats`` are rounded alike on both sides."""
    rounding = floats or {}

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double") + NUDGE * 10.0 ** -d, d)
                                   for c, d in rounding.items()}) if rounding else df

        QUERIES[name] = run
        if sql is not None:
            _SQL[name] = (sql, uses, rounding)
        return fn

    return wrap


def oracles() -> dict[str, str]:
    return {name: with_views(*parts) for name, parts in _SQL.items()}


def with_views(sql: str, uses: tuple[str, ...], rounding: dict[str, int]) -> str:
    needed: list[str] = []

    def add(view: str) -> None:
        for dep in DEPENDS.get(view, ()):
            add(dep)
        if view not in needed:
            needed.append(view)

    for v in uses:
        add(v)
    parts = [f"{v} as ({SQL_VIEWS[v]})" for v in needed] + [f"result as ({sql})"]
    if rounding:
        cols = ", ".join(f'round(cast("{c}" as double) + {NUDGE * 10.0 ** -d!r}, {d}) + 0.0 as "{c}"'
                         for c, d in rounding.items())
        final = f"select * replace ({cols}) from result"
    else:
        final = "select * from result"
    # RECURSIVE is harmless where it is not needed.
    return "with recursive " + ",\n".join(parts) + "\n" + final


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder where every executor can read what another has written."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(prefix: str, column: str, n: int):
    return F.concat(F.lit(prefix), F.lpad((F.col(column) % n).cast("string"), 2, "0"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of 25 pseudo-symbols from line items; one row per symbol and date."""
    o = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(_code("S", "l_suppkey", 25).alias("symbol"),
                 F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
        .agg(F.min_by("l_extendedprice", o).alias("open"), F.max("l_extendedprice").alias("high"),
             F.min("l_extendedprice").alias("low"), F.max_by("l_extendedprice", o).alias("close"),
             F.sum("l_quantity").cast("long").alias("volume"))
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(
        _code("S", "l_suppkey", 25).alias("symbol"), F.col("l_shipdate").cast("date").alias("action_date"),
        signed.alias("amount"), F.col("l_orderkey").cast("string").alias("award_id"))


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy(
        _code("S", "l_suppkey", 25).alias("symbol"), F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("start")
    ).agg(F.sum("l_extendedprice").alias("val"))
    return q.select(
        "symbol", "start", F.date_sub(F.add_months("start", 3), 1).alias("end"), "val",
        F.year("start").alias("fy"), F.concat(F.lit("Q"), F.quarter("start").cast("string")).alias("fp"),
        F.date_add(F.add_months("start", 3), 29).alias("filed"), F.lit("10-Q").alias("form"))


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        _code("S", "o_custkey", 25).alias("symbol"), F.col("o_orderdate").cast("date").alias("event_date"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderkey").cast("string").alias("award_id"))


def otc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(
        _code("T", "l_partkey", 50).alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("trade_date")
    ).agg(F.sum("l_quantity").alias("share_volume"), F.count(F.lit(1)).alias("trade_count"),
          F.countDistinct("l_suppkey").alias("market_makers"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("purchase", "signup", "view"), "Buy").otherwise("Sell")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("order_id"), _code("U", "user_id", 25).alias("symbol"), side.alias("side"),
        F.col("value").alias("price"), (1 + F.col("event_id") % 100).alias("quantity"), "ts",
        F.lit(1.0).alias("commission"))


def ubars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the fill symbols, from traded prices."""
    o = F.struct("ts", "order_id")
    return fills(spark, sf_dir).groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", o).alias("close"), F.sum("quantity").alias("volume"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("series_id"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date")
    ).agg(F.avg("o_totalprice").alias("value"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("symbol"), F.col("doc_id").alias("seq"), day.alias("filed"), "text")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 720).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("agency"), day.alias("post_date"), F.col("text").alias("description"))


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every kind against the weekly bars, priced off the order value."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("Market", "Limit", "Stop", "StopLimit")]), (key % 4 + 1).cast("int"))
    price = F.lit(20000.0) + key % 70000
    return o.select(
        key.alias("id"), _code("S", "o_custkey", 25).alias("symbol"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("date"),
        F.when(F.floor(key / 4) % 2 == 0, "Buy").otherwise("Sell").alias("side"), kind.alias("type"),
        F.lit("Day").alias("tif"), (1 + key % 300).cast("double").alias("quantity"),
        F.when(key % 4 == 1, price).when((key % 4 == 3) & (key % 3 == 0), price - 500).alias("limit_price"),
        F.when(key % 4 >= 2, price).alias("stop_price"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares outstanding per symbol and quarter, from the quantities shipped."""
    return table(spark, sf_dir, "lineitem").groupBy(
        _code("S", "l_suppkey", 25).alias("symbol"), F.date_trunc("quarter", "l_shipdate").alias("ts_available")
    ).agg(F.sum("l_quantity").alias("shares"))


SQL_VIEWS = {
    "bars": """select 'S'||lpad(cast(l_suppkey%25 as varchar),2,'0') symbol, cast(date_trunc('week',l_shipdate) as date) date,
       arg_min(l_extendedprice,o) open, max(l_extendedprice) high, min(l_extendedprice) low,
       arg_max(l_extendedprice,o) close, cast(sum(l_quantity) as bigint) volume
       from (select *, row(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice) o from lineitem) group by 1,2""",
    "transactions": """select 'S'||lpad(cast(l_suppkey%25 as varchar),2,'0') symbol, cast(l_shipdate as date) action_date,
       case when l_returnflag='R' then -l_extendedprice else l_extendedprice end amount, cast(l_orderkey as varchar) award_id from lineitem""",
    "revenue": """select symbol, s as "start", cast(s + interval 3 month - interval 1 day as date) "end", sum(l_extendedprice) val,
       cast(year(s) as int) fy, 'Q'||quarter(s) fp, cast(s + interval 3 month + interval 29 day as date) filed, '10-Q' form
       from (select 'S'||lpad(cast(l_suppkey%25 as varchar),2,'0') symbol, cast(date_trunc('quarter',l_shipdate) as date) s, l_extendedprice from lineitem)
       group by symbol, s""",
    "awards": """select 'S'||lpad(cast(o_custkey%25 as varchar),2,'0') symbol, cast(o_orderdate as date) event_date, o_totalprice amount,
       cast(o_orderkey as varchar) award_id from orders""",
    "otc": """select 'T'||lpad(cast(l_partkey%50 as varchar),2,'0') ticker, cast(date_trunc('week',l_shipdate) as date) trade_date,
       sum(l_quantity) share_volume, count(*) trade_count, count(distinct l_suppkey) market_makers from lineitem group by 1,2""",
    "fills": """select event_id order_id, 'U'||lpad(cast(user_id%25 as varchar),2,'0') symbol,
       case when event_type in ('purchase','signup','view') then 'Buy' else 'Sell' end side,
       value price, 1+event_id%100 quantity, ts, 1.0::double commission from events""",
    "ubars": """select symbol, cast(ts as date) date, arg_min(price,(ts,order_id)) open, max(price) high, min(price) low,
       arg_max(price,(ts,order_id)) as close, cast(sum(quantity) as bigint) volume from fills group by 1,2""",
    "macro": """select o_orderpriority series_id, cast(date_trunc('month',o_orderdate) as date) date, avg(o_totalprice) as value
       from orders group by 1,2""",
    "filings": "select source symbol, doc_id seq, date '2020-01-01' + cast(doc_id as int) filed, text from documents",
    "jobs": "select source agency, date '2020-01-01' + cast(doc_id%720 as int) post_date, text description from documents",
    "orders_view": """select o_orderkey id, 'S'||lpad(cast(o_custkey%25 as varchar),2,'0') symbol,
       cast(date_trunc('week',o_orderdate) as date) date, case when (o_orderkey // 4) % 2 = 0 then 'Buy' else 'Sell' end side,
       ['Market','Limit','Stop','StopLimit'][o_orderkey % 4 + 1] "type", 'Day' tif, cast(1 + o_orderkey % 300 as double) quantity,
       case when o_orderkey % 4 = 1 then 20000.0::double + o_orderkey % 70000
            when o_orderkey % 4 = 3 and o_orderkey % 3 = 0 then 20000.0::double + o_orderkey % 70000 - 500 end limit_price,
       case when o_orderkey % 4 >= 2 then 20000.0::double + o_orderkey % 70000 end stop_price from orders""",
    "shares": """select 'S'||lpad(cast(l_suppkey%25 as varchar),2,'0') symbol, date_trunc('quarter', l_shipdate)::timestamp ts_available,
       sum(l_quantity) shares from lineitem group by 1,2""",
}
DEPENDS: dict[str, tuple[str, ...]] = {"ubars": ("fills",)}
