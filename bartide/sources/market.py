"""Market tables derived from the relational tables: price bars, index levels, fundamentals, ledgers and option chains.

Bars, levels and fundamentals take every row of their inputs. Ledgers, options, corporate actions and announcements are the line items of
certain numbers or sizes, named where they are derived: that choice is what they are, no sample of them. The raw rows are aggregated by (symbol, session) first, with
map-side partial aggregates, so a symbol that holds a third of all rows is combined before any shuffle.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bartide.session import cut_as_dealt, once, spread

BOOK_SIZE = 8  # symbols of one portfolio: bounds every per-portfolio matrix


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def symbol_of(key) -> Column:
    return F.concat(F.lit("SYM"), F.lpad(F.col(key).cast("string"), 10, "0"))


def week_of(ts) -> Column:
    return F.to_date(F.date_trunc("week", F.col(ts)))


def damped_price(turnover, quantity, level: float = 100.0) -> Column:
    """Unit price on a compressed scale, so that weekly returns have the size of market returns."""
    return F.lit(level) * F.pow(F.col(turnover) / F.col(quantity) / 1000, F.lit(0.05))


def arrival_key(*parts: tuple[Column, int]) -> Column:
    """Whole numbers packed into one decimal that sorts like the tuple; each part comes with its number of digits.

    A decimal fits a fixed slot of the aggregation buffer, so first / last prices stay in a hash aggregate; a struct as
    ordering would make Spark sort all raw rows before it aggregates them.
    """
    assert sum(digits for _, digits in parts) <= 38
    key, below = F.lit(0).cast("decimal(38,0)"), 0
    for part, digits in reversed(parts):
        key = (key + part.cast("decimal(20,0)") * F.lit(str(10 ** below)).cast(f"decimal({below + 1},0)")).cast("decimal(38,0)")
        below += digits
    return key


def price_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """One tick per line item: (suppkey, session, price, qty, delivered, at)."""
    rows = table(spark, folder, "lineitem")
    price = damped_price("l_extendedprice", "l_quantity")
    return rows.select(
        F.col("l_suppkey").alias("suppkey"), week_of("l_shipdate").alias("session"), price.alias("price"),
        F.col("l_quantity").alias("qty"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0).alias("delivered"),
        arrival_key((F.unix_date(F.to_date("l_shipdate")), 6), (F.col("l_orderkey"), 15), (F.col("l_linenumber"), 2),
                    (F.col("l_partkey"), 14)).alias("at"))


def bars_from_ticks(ticks: DataFrame, *keys: str) -> DataFrame:
    """Open, high, low, close, volume and turnover per key and session; partial aggregates only."""
    return ticks.groupBy(*keys, "session").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"), F.sum("qty").alias("qty"), F.sum(F.col("price") * F.col("qty")).alias("turnover"),
        F.sum("delivered").alias("deliv_qty"), F.count(F.lit(1)).alias("trades"))


def _unlinked_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars_from_ticks(price_ticks(spark, folder), "suppkey").withColumn("symbol", symbol_of("suppkey"))


def _linked(bars: DataFrame) -> DataFrame:
    return bars.withColumn("prev_close", F.lag("close").over(Window.partitionBy("symbol").orderBy("session")))


@once
def weekly_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly bars per supplier symbol with the previous close; one row per (symbol, session)."""
    return _linked(_unlinked_bars(spark, folder))


def by_symbol(spark: SparkSession, folder: str, bars: DataFrame) -> DataFrame:
    """Weekly bars exchanged by symbol for all windows that follow; the number of line items bounds that of bars and is in the file footers."""
    return spread(bars, table(spark, folder, "lineitem").count(), "symbol")


def weekly_bars_by_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """`weekly_bars` where windows by symbol follow: their one exchange is that of `by_symbol`, and tasks do not grow with the input."""
    return _linked(by_symbol(spark, folder, _unlinked_bars(spark, folder)))


@partial(once, store=cut_as_dealt)
def panel_bars(spark: SparkSession, folder: str) -> DataFrame:
    """What a price panel reads of the weekly bars, dealt by symbol and in order. `with_previous` adds the previous close."""
    bars = _unlinked_bars(spark, folder).select("symbol", "session", "high", "low", "close", "qty", "turnover", "deliv_qty")
    return by_symbol(spark, folder, bars).sortWithinPartitions("symbol", "session")


@partial(once, store=cut_as_dealt)
def close_bars(spark: SparkSession, folder: str) -> DataFrame:
    """What returns and books read of the weekly bars, dealt by symbol and in order."""
    bars = _unlinked_bars(spark, folder).select("suppkey", "symbol", "session", "close", "turnover")
    return by_symbol(spark, folder, bars).sortWithinPartitions("symbol", "session")


def with_previous(bars: DataFrame) -> DataFrame:
    return _linked(bars)


def intraday_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Four-hour bars per event type from the event stream."""
    ticks = table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), F.window("ts", "4 hours").start.alias("session"), F.col("value").alias("price"),
        F.lit(1.0).alias("qty"), F.lit(0.0).alias("delivered"), arrival_key((F.unix_micros(F.col("ts").cast("timestamp")), 18), (F.col("event_id"), 18)).alias("at"))
    return bars_from_ticks(ticks, "symbol")


def numbered_calendar(bars: DataFrame) -> DataFrame:
    """(session, n): the sessions of all symbols, numbered from 1. Bounded by the calendar, not by the data."""
    days = bars.select("session").distinct()
    return days.withColumn("n", F.row_number().over(Window.orderBy("session")))


def benchmark(bars: DataFrame) -> DataFrame:
    """(session, bench): volume-weighted mean price of all symbols."""
    return bars.groupBy("session").agg((F.sum("turnover") / F.sum("qty")).alias("bench"))


@once
def listings(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, suppkey, company, sector): the sector is the region of the supplier's nation."""
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(symbol_of("s_suppkey").alias("symbol"), F.col("s_suppkey").alias("suppkey"),
                    F.col("s_name").alias("company"), F.col("r_name").alias("sector"), F.col("s_acctbal").alias("acctbal")))


def portfolio_of(key: str = "suppkey") -> Column:
    return F.floor(F.col(key) / BOOK_SIZE).cast("long")


def books(bars: DataFrame) -> DataFrame:
    """(portfolio, symbol, weight): books of BOOK_SIZE neighbouring symbols, weighted by their share of turnover."""
    held = bars.groupBy("suppkey", "symbol").agg(F.sum("turnover").alias("value"))
    held = held.withColumn("portfolio", portfolio_of())
    return held.select("portfolio", "symbol", "suppkey",
                       (F.col("value") / F.sum("value").over(Window.partitionBy("portfolio"))).alias("weight"))


@once
def fundamentals(spark: SparkSession, folder: str) -> DataFrame:
    """Nullable ratios per symbol from the line items; every seventh symbol misses roce and debt_to_equity."""
    rows = table(spark, folder, "lineitem")
    late = F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp")
    odd = F.col("l_linenumber") % 2 == 1
    quarter = (F.col("l_shipdate") >= F.lit("2001-07-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("2001-10-01").cast("timestamp"))
    year_ago = (F.col("l_shipdate") >= F.lit("2000-07-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("2000-10-01").cast("timestamp"))
    value, margin = F.col("l_extendedprice"), F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax") / 2)
    sums = rows.groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        (F.sum(value) / 1e5).alias("market_cap"), (F.avg("l_discount") * 400).alias("roce_raw"), (F.avg("l_tax") * 300).alias("opm"),
        (F.avg("l_quantity") / 25.5).alias("de_raw"), (F.sum(F.when(odd, value).otherwise(-value)) / 1e5).alias("operating_cash_flow"),
        (F.avg(value) / 1e4).alias("interest_coverage"),
        (F.avg(F.when(F.col("l_returnflag") == "R", 100.0).otherwise(0.0))).alias("pledged_pct"),
        F.sum(F.when(late, value)).alias("late_value"), F.sum(F.when(~late, value)).alias("early_value"),
        (F.sum(F.when(quarter, margin)) / 1e3).alias("qtr_net_profit"), (F.sum(F.when(year_ago, margin)) / 1e3).alias("profit_year_ago"),
        F.sum(F.when(quarter, value)).alias("qtr_sales"), F.sum(F.when(year_ago, value)).alias("sales_year_ago"))
    reported = F.col("suppkey") % 7 != 0
    return sums.select(
        symbol_of("suppkey").alias("symbol"), "suppkey", "market_cap", F.when(reported, F.col("roce_raw")).alias("roce"), "opm",
        F.when(reported, F.col("de_raw")).alias("debt_to_equity"), "operating_cash_flow", "interest_coverage", "pledged_pct",
        ((F.col("late_value") / F.col("early_value") - 1) * 100).alias("sales_growth_3yr"), "qtr_net_profit",
        ((F.col("qtr_net_profit") - F.col("profit_year_ago")) / F.abs("profit_year_ago") * 100).alias("qtr_profit_yoy"),
        ((F.col("qtr_sales") / F.col("sales_year_ago") - 1) * 100).alias("qtr_sales_yoy"))


# fixed values: screen criteria per sector (sector, ord, field, op, threshold, label, hard)
CRITERIA = [
    ("AFRICA", 1, "market_cap", ">=", 300.0, "Market cap >= 300", True),
    ("AFRICA", 2, "roce", ">", 20.0, "ROCE > 20%", False),
    ("AFRICA", 3, "opm", ">", 12.0, "OPM > 12%", False),
    ("AFRICA", 4, "pledged_pct", "<", 35.0, "Pledged < 35%", True),
    ("AMERICA", 1, "market_cap", ">=", 300.0, "Market cap >= 300", True),
    ("AMERICA", 2, "roce", ">", 20.0, "ROCE > 20%", False),
    ("AMERICA", 3, "debt_to_equity", "<", 1.02, "Debt to equity < 1.02", True),
    ("AMERICA", 4, "opm", ">", 12.0, "OPM > 12%", False),
    ("ASIA", 1, "market_cap", ">=", 300.0, "Market cap >= 300", True),
    ("ASIA", 2, "interest_coverage", ">", 5.0, "Interest coverage > 5", True),
    ("ASIA", 3, "operating_cash_flow", ">", 0.0, "Cash from operations > 0", False),
    ("EUROPE", 1, "roce", ">", 19.0, "ROCE > 19%", False),
    ("EUROPE", 2, "opm", ">=", 11.5, "OPM >= 11.5%", False),
    ("EUROPE", 3, "sales_growth_3yr", ">", 5.0, "Sales growth > 5%", False),
    ("EUROPE", 4, "pledged_pct", "<", 36.0, "Pledged < 36%", True),
    ("MIDDLE EAST", 1, "market_cap", ">=", 300.0, "Market cap >= 300", True),
    ("MIDDLE EAST", 2, "pledged_pct", "<=", 34.0, "Pledged <= 34%", True),
    ("MIDDLE EAST", 3, "operating_cash_flow", ">", 0.0, "Cash from operations > 0", False),
]


def criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CRITERIA, "sector string, ord int, field string, op string, threshold double, label string, hard boolean")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger per portfolio: first line items buy, returned ones sell; line 7 trades an index option."""
    rows = table(spark, folder, "lineitem").where(F.col("l_linenumber").isin(1, 7))
    option = F.col("l_linenumber") == 7
    strike = F.floor(F.col("l_discount") * 100) + 95
    contract = F.concat_ws(" ", F.lit("INDEX"), F.concat(F.year("l_shipdate").cast("string"), F.lit("-12-28")),
                           strike.cast("string"), F.when(F.col("l_partkey") % 3 == 0, "CE").otherwise("PE"))
    price = damped_price("l_extendedprice", "l_quantity")
    return rows.select(
        F.floor(F.col("l_suppkey") / BOOK_SIZE).cast("long").alias("portfolio"), week_of("l_shipdate").alias("session"),
        F.when(option, contract).otherwise(symbol_of("l_suppkey")).alias("instrument"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("action"), F.col("l_quantity").alias("quantity"),
        F.when(option, price / 20).otherwise(price).alias("price"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ref"), _note(option).alias("note"))


def _note(option: Column) -> Column:
    """Some sales park their proceeds, some purchases redeploy what their own symbol parked before."""
    sold = F.col("l_returnflag") == "R"
    parks, redeploys = ~option & sold & (F.col("l_orderkey") % 6 == 0), ~option & ~sold & (F.col("l_orderkey") % 40 == 0)
    text = F.concat(F.lit("redeploys "), symbol_of("l_suppkey"), F.lit("'s parked proceeds: replaces it"))
    return F.when(parks, "stop-loss exit; proceeds parked in the liquid ETF").when(redeploys, text).otherwise("")


def factor_levels(spark: SparkSession, folder: str, bars: DataFrame) -> DataFrame:
    """(session, market, large, bond, rate): index levels on the session calendar."""
    large = F.col("qty") * F.when(F.col("suppkey") % 3 == 0, 1.0).otherwise(0.0)
    per_week = bars.groupBy("session").agg(
        (F.sum("turnover") / F.sum("qty")).alias("market"),
        (F.sum(F.col("turnover") * F.when(F.col("suppkey") % 3 == 0, 1.0).otherwise(0.0)) / F.sum(large)).alias("large"),
        (F.sum("deliv_qty") / F.sum("qty")).alias("delivered"))
    bond = (table(spark, folder, "orders").groupBy(week_of("o_orderdate").alias("session"))
            .agg((F.lit(100.0) * F.pow(F.avg("o_totalprice") / 200000, F.lit(0.2))).alias("bond")))
    running = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (per_week.join(bond, "session", "left")
            .withColumn("rate", F.lit(1000.0) * F.exp(F.sum(F.lit(0.0008) + F.col("delivered") * 0.0004).over(running)))
            .select("session", "market", "large", "bond", "rate"))


def foreign_closes(spark: SparkSession, folder: str) -> DataFrame:
    """(day, close): a daily foreign series from the orders, on its own calendar."""
    return (table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
            .agg((F.lit(80.0) * F.pow(F.avg("o_totalprice") / 200000, F.lit(0.1))).alias("close")))


def option_chain(spark: SparkSession, folder: str) -> DataFrame:
    """A chain per underlying brand: strikes, settlement prices and open interest from the parts."""
    parts = table(spark, folder, "part").select(
        F.col("p_brand").alias("underlying"), (F.floor(F.col("p_retailprice") / 25) * 25.0).alias("strike"),
        F.when(F.col("p_partkey") % 2 == 0, "PE").otherwise("CE").alias("kind"),
        F.add_months(F.lit("2001-12-28").cast("date"), (F.col("p_size") % 3).cast("int")).alias("expiry"),
        F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("ref"))
    spot = parts.groupBy("underlying").agg(F.avg("ref").alias("spot"))
    legs = parts.groupBy("underlying", "expiry", "strike", "kind").agg(
        F.sum("size").alias("oi"), F.avg("size").alias("mean_size"), F.count(F.lit(1)).alias("contracts"))
    # the spot of the session: the brand's mean price
    priced = legs.join(spot, "underlying")
    gain = F.when(F.col("kind") == "CE", F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot"))
    premium = F.greatest(gain, F.lit(0.0)) + F.col("spot") * (0.01 + F.col("mean_size") / 1000)
    return priced.select("underlying", F.lit("2001-11-05").cast("date").alias("trade_date"), "expiry", "strike", "kind", "spot",
                         premium.alias("settle"), "oi", "contracts")


# fixed values: wording of corporate-action subjects
SUBJECTS = ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To  Rs 2/- Per Share", "Bonus 1:2",
            "Composite Scheme of Arrangement", "Interim Dividend - Rs 3 Per Share")
# fixed values: exchange holidays of the sample calendar
HOLIDAYS = ("1995-01-26", "1996-08-15", "1997-12-25", "1998-05-01", "2001-11-16", "2001-12-25", "2024-01-15", "2024-01-26")
EXTRA_SESSIONS = ("2001-11-18", "2024-01-20")


def raw_actions(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, ex_text, ord, subject): corporate actions as published, one per large third line item."""
    rows = table(spark, folder, "lineitem").where((F.col("l_linenumber") == 3) & (F.col("l_quantity") >= 49))
    subject = F.element_at(F.array(*[F.lit(s) for s in SUBJECTS]), (F.col("l_partkey") % 4 + 1).cast("int"))
    return rows.select(symbol_of("l_suppkey").alias("symbol"), F.date_format(week_of("l_shipdate"), "dd-MMM-yyyy").alias("ex_text"),
                       (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("ord"), subject.alias("subject"))


def index_levels(spark: SparkSession, folder: str, bars: DataFrame) -> DataFrame:
    """(index_name, session, price, level): one index per sector; published levels miss every ninth calendar week and
    price levels every 26th."""
    sector = listings(spark, folder).select("symbol", "sector")
    priced = (bars.join(sector, "symbol").groupBy(F.col("sector").alias("index_name"), "session")
              .agg((F.sum("turnover") / F.sum("qty")).alias("_p")))
    week = F.weekofyear("session")
    return priced.select("index_name", "session", F.when(week % 26 != 0, F.col("_p")).alias("price"),
                         F.when(week % 9 != 0, F.col("_p") * 1.5).alias("level"))


def option_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Option trades per portfolio: seventh line items trade the contract their part stands for in the chain."""
    rows = table(spark, folder, "lineitem").where(F.col("l_linenumber") == 7)
    parts = table(spark, folder, "part")
    joined = rows.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.floor(F.col("l_suppkey") / BOOK_SIZE).cast("long").alias("portfolio"), F.col("p_brand").alias("underlying"),
        F.add_months(F.lit("2001-12-28").cast("date"), (F.col("p_size") % 3).cast("int")).alias("expiry"),
        (F.floor(F.col("p_retailprice") / 25) * 25.0).alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "PE").otherwise("CE").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("action"), F.col("l_quantity").alias("quantity"),
        week_of("l_shipdate").alias("session"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("price"))


def hedge_underlying(portfolio) -> Column:
    """The index a portfolio hedges on."""
    return F.concat(F.lit("Brand#"), (F.col(portfolio) % 25 + 1).cast("string"))
