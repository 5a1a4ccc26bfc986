"""Registered queries: landed files, JSON and HTML documents, streams."""

from __future__ import annotations

import uuid
from html.entities import html5

from pyspark.sql import functions as F

from bartide.functions import text
from bartide.functions.numbers import half_away
from bartide.operators import rolling as rl
from bartide.plans.catalog import Query
from bartide.plans.ledger import STOP_DAY, STOP_SHARE
from bartide.plans.market_sql import SYMBOL, with_tables
from bartide.session import shared_folder
from bartide.sources import batches, files
from bartide.sources import market as mk
from bartide.streaming import market as sm


def scratch(spark, name):
    """A new folder under the shared one for each run."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def company_years(spark, folder):
    """Yearly figures per symbol, as a company page lists them."""
    rows = mk.table(spark, folder, "lineitem")
    value = F.col("l_extendedprice")
    cash = F.when(F.col("l_linenumber") % 2 == 1, value).otherwise(-value)
    sums = rows.groupBy(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").alias("year")).agg(
        F.sum(value).alias("v"), F.sum(value * F.col("l_discount")).alias("d"), F.sum(value * F.col("l_tax")).alias("t"), F.sum(cash).alias("c"),
        F.avg("l_discount").alias("r"), F.sum("l_quantity").alias("q"))
    return sums.select("suppkey", "year", half_away(F.col("v") / 1e4, 1).alias("sales"), half_away(F.col("d") / 1e4, 1).alias("operating"),
                       half_away(F.col("t") / 1e5, 1).alias("interest"), half_away(F.col("d") / 1e4 - F.col("t") / 1e5, 1).alias("before_tax"),
                       half_away(F.col("c") / 1e4, 1).alias("cash"), half_away(F.col("r") * 400, 1).alias("roce"), half_away(F.col("q") / 100, 1).alias("debt"))


def company_pages(spark, folder):
    """HTML page per symbol built from its yearly figures. Every third symbol has a trailing TTM column with figures of its own; some
    list items and growth cells have no number."""
    figures = ["sales", "operating", "interest", "before_tax", "cash", "roce", "debt"]
    years = company_years(spark, folder).groupBy("suppkey").agg(F.array_sort(F.collect_list(F.struct("year", *figures))).alias("y"))
    ttm = F.col("suppkey") % 3 == 0

    def cells(name, extra=None):
        shown = F.transform("y", lambda r: F.concat(F.lit("<td>"), F.format_number(r[name], 1), F.lit("</td>")))
        joined = F.array_join(shown, "")
        twelve = F.concat(F.lit("<td>"), F.format_number(F.element_at("y", -1)[name] + F.lit(extra), 1), F.lit("</td>"))
        return joined if extra is None else F.concat(joined, F.when(ttm, twelve).otherwise(""))

    def item(title, number):
        return F.concat(F.lit(f'<li class="flex"> <span class="name"> {title} </span><span class="value"><span class="number">'), F.coalesce(number, F.lit("")), F.lit("</span></span></li>"))

    def growth(title, three):
        return F.concat(F.lit(f'<table class="ranges-table"><tbody><tr><th colspan="2">Compounded {title} Growth</th></tr><tr><td>10 Years:</td><td>99%</td></tr><tr><td>3 Years:</td><td>'),
                        three, F.lit("</td></tr></tbody></table>"))

    def row(title, name, extra=None):
        return F.concat(F.lit(f'<tr class="stripe"><td class="text">{title}</td>'), cells(name, extra), F.lit("</tr>"))

    heads = F.array_join(F.transform("y", lambda r: F.concat(F.lit("<th>Mar "), r["year"].cast("string"), F.lit("</th>"))), "")
    last = F.element_at("y", -1)
    html = F.concat(
        F.lit('<html><body><ul id="top-ratios">'), item("Market Cap", F.format_number(F.aggregate(F.transform("y", lambda r: r["sales"]), F.lit(0.0), lambda a, v: a + v), 1)),
        item("Current Price", F.when(F.col("suppkey") % 4 != 0, F.format_number(last["debt"], 1))), item("ROCE 3Yr", F.lit("77.7")), item("ROCE", F.format_number(last["roce"], 1)),
        item("ROE", F.format_number(last["roce"] + 1, 1)), F.lit("</ul>"),
        growth("Sales", F.concat(F.format_number(last["cash"], 1), F.lit("%"))), growth("Profit", F.when(F.col("suppkey") % 5 != 0, F.concat(F.format_number(last["interest"], 1), F.lit("%"))).otherwise("%")),
        F.lit('<section id="profit-loss"><table><thead><tr><th></th>'), heads, F.when(ttm, F.lit("<th>TTM</th>")).otherwise(""), F.lit("</tr></thead><tbody>"),
        row("<button>Sales&nbsp;<span>+</span></button>", "sales", 10.0), row("Operating Profit", "operating", 3.0), row("Interest", "interest", 5000.0),
        row("Profit before tax", "before_tax", 7000.0), F.lit("</tbody></table></section>"),
        F.lit('<section id="balance-sheet"><table><tbody>'), row("Equity Capital", "interest"), row("Reserves", "operating"), row("Borrowings +", "debt"), F.lit("</tbody></table></section>"),
        F.lit('<section id="cash-flow"><table><tbody>'), row("Cash from Operating Activity +", "cash"), F.lit("</tbody></table></section>"),
        F.lit('<section id="ratios"><table><tbody>'), row("ROCE %", "roce"), F.lit("</tbody></table></section></body></html>"))
    return years.select(mk.symbol_of("suppkey").alias("symbol"), html.alias("html"))


def company_metrics(spark, folder):
    metrics = text.page_metrics("html")
    return company_pages(spark, folder).select("symbol", *[c.alias(n) for n, c in metrics.items()])


def pledges(spark, folder):
    """JSON disclosures per order (a handful of lines each), the latest one read back; every fifth order has none."""
    rows = mk.table(spark, folder, "lineitem")
    record = F.struct(F.date_format("l_shipdate", "dd-MMM-yyyy").alias("shp"), F.when(F.col("l_linenumber") == 6, "").otherwise(
        F.format_string("%.2f", F.col("l_discount") * 100)).alias("percPromoterShares"))
    listed = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", record.alias("rec")))).alias("_l"))
    listed = listed.withColumn("data", F.when(F.col("l_orderkey") % 5 == 0, F.array().cast("array<struct<shp:string,percPromoterShares:string>>")).otherwise(F.transform("_l", lambda x: x["rec"])))
    payload = listed.select(F.col("l_orderkey").alias("orderkey"), F.to_json(F.struct("data")).alias("payload"))
    return payload.withColumn("pledged_pct", files.pledge_share("payload"))


def auctions(spark, folder):
    """An auction release per order, as the page that announces it; every seventh is not filled in yet."""
    rows = mk.table(spark, folder, "orders")
    pct = F.format_string("%.7f", F.col("o_totalprice") / 100000)
    html = F.concat(F.lit("<html><head><style>td{color:red}</style></head><body><b>Date : "), F.date_format("o_orderdate", "MMM d, yyyy"),
                    F.lit("</b><table><tr><td>Cut-off price (&#8377;) / Yield</td><td>98.60&nbsp; "),
                    F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("(YTM: "), pct, F.lit("%)"))).otherwise("to follow"), F.lit("</td></tr></table></body></html>"))
    # exploded, because an optimiser that pushes the filter down would read each page several times
    read = rows.select(F.col("o_orderkey").alias("orderkey"), html.alias("html")).select("orderkey", F.explode(F.array(text.auction_parts("html"))).alias("a"))
    return read.where(F.col("a").isNotNull()).select("orderkey", "a.released", "a.yield_pct")


def redacted(spark, folder):
    """Stored pages with a signed link appended, its credentials redacted."""
    link = F.concat(F.lit('<a href="https://files.example/x?X-Amz-Credential=AK'), F.md5("url"), F.lit("&X-Amz-Signature="), F.md5("html"), F.lit('&n=1">file</a>'))
    rows = mk.table(spark, folder, "pages").select("page_id", F.concat("html", link).alias("html"))
    return rows.select("page_id", F.md5(text.redact_signatures("html")).alias("digest"))


def page_texts(spark, folder):
    """Visible text of every stored page."""
    rows = mk.table(spark, folder, "pages").select("page_id", text.visible_text("html").alias("t"))
    return rows.select("page_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


def price_files(spark, folder):
    """Bars written as daily price text files (padding, thousands separators, several series) and read back.

    Written once per year partition into the shared folder; the reader sees only text."""
    path = scratch(spark, "prices")
    bars = mk.weekly_bars(spark, folder)
    series = F.when(F.col("trades") % 3 == 0, " XX").when(F.col("trades") % 3 == 1, " EQ").otherwise(" BE ")

    def shown(name):
        return F.concat(F.lit(" "), F.format_number(name, 6))

    out = bars.select(
        F.concat("symbol", F.lit(" ")).alias("SYMBOL"), series.alias("SERIES"), F.date_format("session", "dd-MMM-yyyy").alias("DATE1"),
        F.when(F.col("prev_close").isNotNull(), shown("prev_close")).otherwise("-").alias("PREV_CLOSE"), shown("open").alias("OPEN_PRICE"), shown("high").alias("HIGH_PRICE"),
        shown("low").alias("LOW_PRICE"), shown("close").alias("CLOSE_PRICE"), shown("turnover").alias("TURNOVER_LACS"), F.format_number("qty", 0).alias("TTL_TRD_QNTY"),
        F.year("session").alias("year"))
    files.write_table(out, path, ["year"], csv=True)
    return files.read_prices(spark, path, "1996-01-01", "2000-12-31", series=files.RETURN_SERIES)


def index_files(spark, folder):
    """Sector index levels written as index files of one directory; one index read back by its untidy name."""
    path = scratch(spark, "index")
    levels = mk.index_levels(spark, folder, mk.weekly_bars(spark, folder))
    out = levels.select(F.concat(F.lit(" "), F.initcap("index_name")).alias("Index Name"), F.date_format("session", "dd-MM-yyyy").alias("Index Date"),
                        F.coalesce(F.format_number("price", 6), F.lit("-")).alias("Closing Index Value"), F.year("session").alias("year"))
    files.write_table(out, path, ["year"], csv=True)
    return files.read_index(spark, path, "middle east").select("index_name", "session", "close")


def total_return_files(spark, folder):
    path = scratch(spark, "tri")
    levels = mk.index_levels(spark, folder, mk.weekly_bars(spark, folder))
    out = levels.select(F.col("index_name").alias("IndexName"), F.date_format("session", "dd MMM yyyy").alias("Shown"), F.date_format("session", "dd-MMM-yyyy").alias("Date"),
                        F.coalesce(F.format_number("level", 6), F.lit("")).alias("Total Returns Index"), F.format_number("price", 6).alias("Net Total Return Index"))
    files.write_table(out, path, csv=True)
    return files.read_total_return(spark, path, "2000-12-31")


def ledger_files(spark, folder):
    """Ledgers written as display CSV and read back with a schema."""
    path = scratch(spark, "ledger")
    out = mk.trades(spark, folder).select(F.col("session").cast("string").alias("date"), "instrument", "action", F.col("quantity").cast("string").alias("quantity"),
                                          F.format_string("%.4f", "price").alias("price"), "note")
    files.write_table(out, path, csv=True)
    rows = files.read_ledger(spark, path)
    return rows.groupBy("instrument", "action").agg(F.count(F.lit(1)).alias("rows"), F.min("session").alias("first"), F.sum("quantity").alias("quantity"),
                                                    F.sum(F.col("price") * F.col("quantity")).alias("amount"), F.count_if(F.length("note") > 0).alias("noted"))


def unusual_numbers(spark, folder):
    """NaN is missing, infinities are values: order values with both injected."""
    from bartide.functions.numbers import is_infinite, missing_to_null

    rows = mk.table(spark, folder, "orders")
    key = F.col("o_orderkey")
    odd = F.when(key % 11 == 0, float("nan")).when(key % 13 == 0, float("inf")).otherwise(F.col("o_totalprice"))
    clean = rows.select("o_orderpriority", missing_to_null(odd).alias("v"))
    return clean.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("v").alias("known"), F.count_if(is_infinite("v")).alias("infinite"), F.sum(F.when(~is_infinite("v"), F.col("v"))).alias("total"))


def session_counts(spark, folder):
    """Exact number of sessions with ticks per symbol."""
    rows = mk.table(spark, folder, "lineitem").select(mk.symbol_of("l_suppkey").alias("symbol"), mk.week_of("l_shipdate").alias("session"))
    return rows.groupBy("symbol").agg(F.countDistinct("session").alias("sessions"))


def event_stream(spark, folder):
    schema = mk.table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant


def streamed_bars(spark, folder):
    """Four-hour bars of the event stream; a bar is final once the watermark has passed its end, the open ones are closed by a last batch."""
    path = scratch(spark, "bars")
    columns = ("ts", "event_type", "value", "event_id")
    sm.run_to_table(sm.bars(event_stream(spark, folder), *columns), f"{path}/table", f"{path}/state")
    ticks = mk.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sm.with_open_bars(spark.read.parquet(f"{path}/table"), ticks, *columns)


def intraday(spark, folder):
    bars = mk.intraday_bars(spark, folder)
    return bars.withColumn("ret", F.col("close") / rl.back("close", 1) - 1)


def streamed_first(spark, folder):
    """One event per user and type and hour. Repeats share their hour, so a watermark of one hour finds them all and the state holds the last hours only."""
    path = scratch(spark, "first")
    stream = event_stream(spark, folder).withColumn("hour", F.date_trunc("hour", "ts"))
    sm.run_to_table(sm.first_per_key(stream, "ts", ["user_id", "event_type", "hour"], "1 hour").select("user_id", "event_type", "hour"), f"{path}/table", f"{path}/state")
    return spark.read.parquet(f"{path}/table")


def streamed_latest(spark, folder):
    """Keep-last per user and type: batches appended and merged in levels, the few versions of a key resolved on reading."""
    path, key = scratch(spark, "latest"), ["user_id", "event_type"]
    stream = event_stream(spark, folder).select("user_id", "event_type", "event_id", "ts", "value")
    sm.append_latest(stream, f"{path}/table", f"{path}/state", key, "event_id").awaitTermination()
    return batches.read_latest(spark, f"{path}/table", stream.schema, key, "event_id")


def streamed_alerts(spark, folder):
    """Line items arriving as closes, checked against the stops."""
    path = scratch(spark, "alerts")
    bars = mk.weekly_bars(spark, folder)
    before = bars.where(F.col("session") <= F.lit(STOP_DAY).cast("date"))
    stops = before.groupBy("symbol").agg((F.max_by("close", "session") * STOP_SHARE).alias("stop"))
    schema = mk.table(spark, folder, "lineitem").schema
    rows = spark.readStream.schema(schema).parquet(f"{folder}/lineitem.parque[t]")
    closes = rows.select(mk.symbol_of("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey",
                         mk.damped_price("l_extendedprice", "l_quantity").alias("close"))
    late = closes.where(F.col("day") > F.lit(STOP_DAY).cast("date"))
    sm.run_to_table(sm.stop_alerts(late, stops), f"{path}/table", f"{path}/state")
    return spark.read.parquet(f"{path}/table")


YEARS_SQL = """
SELECT *, row_number() OVER (PARTITION BY suppkey ORDER BY year DESC) AS k FROM (SELECT l_suppkey AS suppkey, year(l_shipdate) AS year, round(sum(l_extendedprice) / 1e4, 1) AS sales, round(sum(l_extendedprice * l_discount) / 1e4, 1) AS operating,
  round(sum(l_extendedprice * l_tax) / 1e5, 1) AS interest, round(sum(l_extendedprice * l_discount) / 1e4 - sum(l_extendedprice * l_tax) / 1e5, 1) AS before_tax,
  round(sum(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice ELSE -l_extendedprice END) / 1e4, 1) AS cash, round(avg(l_discount) * 400, 1) AS roce, round(sum(l_quantity) / 100, 1) AS debt FROM lineitem GROUP BY 1, 2)"""
# the text of a page in SQL: tags out, then the parts behind each ampersand decoded by themselves
_TAGLESS = "regexp_replace(regexp_replace(html, '<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'g')"
# every name of the standard library's table of HTML 5, quoted for SQL
_QUOTED = {n: "'" + n.replace("'", "''") + "'" for n in html5}
_KNOWN = "MAP {" + ", ".join(f"{_QUOTED[n]}: " + " || ".join(f"chr({ord(c)})" for c in chars) for n, chars in sorted(html5.items())) + "}"
_ODD = "MAP {" + ", ".join(f"{n}: chr({ord(c)})" for n, c in text.ODD_NUMBERS.items()) + "}"
_POINT = "CASE WHEN d <> '' THEN CASE WHEN len(ltrim(d, '0')) > 8 THEN 1114112 ELSE CAST(d AS BIGINT) END WHEN len(ltrim(h, '0')) > 6 THEN 1114112 ELSE CAST('0x' || h AS BIGINT) END"
PAGE_TEXT_SQL = rf"""
WITH bare AS (SELECT page_id, string_split({_TAGLESS}, '&') AS parts FROM pages),
cut AS (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM bare),
seen AS (SELECT *, regexp_extract(part, '^#([0-9]+);?', 1) AS d, regexp_extract(part, '^#[xX]([0-9a-fA-F]+);?', 1) AS h, regexp_extract(part, '^#([0-9]+|[xX][0-9a-fA-F]+);?') AS num,
    regexp_extract(part, '^[^\t\n\f <&#;]{{1,32}};?') AS whole, regexp_extract(part, '^({"|".join(text.BARE_NAMES)})') AS short FROM cut),
known AS (SELECT MAP(list(n), list(v)) AS m FROM (SELECT unnest(map_keys(t)) AS n, unnest(map_values(t)) AS v FROM (SELECT {_KNOWN} AS t))),
valued AS (SELECT *, CASE WHEN num <> '' THEN {_POINT} END AS point, m[whole] AS w, m[short] AS s FROM seen, known),
decoded AS (SELECT page_id, k, CASE WHEN k = 0 THEN part WHEN num <> '' THEN coalesce({_ODD}[point], CASE WHEN point > 1114111 OR point BETWEEN 55296 AND 57343 THEN chr(65533)
    WHEN point BETWEEN 1 AND 8 OR point = 11 OR point BETWEEN 14 AND 31 OR point = 127 OR point BETWEEN 64976 AND 65007 OR point % 65536 >= 65534 THEN '' ELSE chr(CAST(point AS INTEGER)) END) || part[len(num) + 1:]
    WHEN w IS NOT NULL THEN w || part[len(whole) + 1:] WHEN short <> '' THEN s || part[len(short) + 1:] ELSE '&' || part END AS t FROM valued)
SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, regexp_replace(string_agg(t, '' ORDER BY k), '[ \t\n\x0B\f\r\x{{00A0}}]+', ' ', 'g') AS t FROM decoded GROUP BY page_id)"""

QUERIES = [
    Query("company_page_metrics", "S10 X19", "symbol:s market_cap:1 current_price:1 roe:1 sales_growth_3yr:1 profit_growth_3yr:1 roce:1 roce_3yr_avg:2 operating_cash_flow:1 operating_cash_flow_3yr:2 interest_coverage:2 debt_to_equity:2 opm:2", company_metrics, with_tables(f"""
SELECT {SYMBOL.format('suppkey')} AS symbol, sum(sales) AS market_cap, CASE WHEN suppkey % 4 <> 0 THEN max(debt) FILTER (k = 1) END AS current_price, max(roce) FILTER (k = 1) + 1 AS roe, max(cash) FILTER (k = 1) AS sales_growth_3yr,
  CASE WHEN suppkey % 5 <> 0 THEN max(interest) FILTER (k = 1) END AS profit_growth_3yr, max(roce) FILTER (k = 1) AS roce, round_even(avg(roce) FILTER (k <= 3), 2) AS roce_3yr_avg, max(cash) FILTER (k = 1) AS operating_cash_flow,
  CASE WHEN count(*) >= 3 THEN round_even(sum(cash) FILTER (k <= 3), 2) END AS operating_cash_flow_3yr, CASE WHEN max(interest) FILTER (k = 1) > 0 THEN round_even((max(before_tax) FILTER (k = 1) + max(interest) FILTER (k = 1)) / max(interest) FILTER (k = 1), 2) END AS interest_coverage,
  round_even(max(debt) FILTER (k = 1) / (max(interest) FILTER (k = 1) + max(operating) FILTER (k = 1)), 2) AS debt_to_equity,
  round_even((max(operating) FILTER (k = 1) + CASE WHEN suppkey % 3 = 0 THEN 3 ELSE 0 END) / (max(sales) FILTER (k = 1) + CASE WHEN suppkey % 3 = 0 THEN 10 ELSE 0 END) * 100, 2) AS opm FROM years GROUP BY suppkey""", years=YEARS_SQL)),
    Query("pledge_disclosures", "S8 X18", "orderkey:i pledged_pct:2", pledges, """
SELECT l_orderkey AS orderkey, CASE WHEN l_orderkey % 5 = 0 THEN 0.0 ELSE CASE WHEN arg_min(l_linenumber, (-epoch(l_shipdate), l_linenumber, l_suppkey, l_partkey)) = 6 THEN NULL
  ELSE arg_min(round(l_discount * 100, 2), (-epoch(l_shipdate), l_linenumber, l_suppkey, l_partkey)) END END AS pledged_pct FROM lineitem GROUP BY 1"""),
    Query("auction_releases", "X21", "orderkey:i released:d yield_pct:7", auctions, """
SELECT o_orderkey AS orderkey, CAST(o_orderdate AS DATE) AS released, o_totalprice / 100000 AS yield_pct FROM orders WHERE o_orderkey % 7 <> 0"""),
    Query("redacted_pages", "X22", "page_id:i digest:s", redacted, """
SELECT page_id, md5(html || '<a href="https://files.example/x?X-Amz-Credential=REDACTED&X-Amz-Signature=REDACTED&n=1">file</a>') AS digest FROM pages"""),
    Query("page_texts", "X21 F1", "page_id:i chars:i digest:s", page_texts, PAGE_TEXT_SQL),
    Query("price_files", "S1 S2 S4 S13 F1 F2", "symbol:s session:d prev_close:6 open:6 high:6 low:6 close:6 qty:0 turnover:6", price_files, with_tables("""
SELECT symbol, session, prev_close, open, high, low, close, qty, turnover FROM bars WHERE trades % 3 <> 0 AND session BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")),
    Query("index_files", "S3 D2", "index_name:s session:d close:6", index_files, with_tables(
        "SELECT 'middle east' AS index_name, session, price AS close FROM index_levels WHERE index_name = 'MIDDLE EAST' AND price IS NOT NULL")),
    Query("total_return_files", "S5 D3", "index_name:s session:d tri:6 net_tri:6", total_return_files, with_tables(
        "SELECT index_name, session, level AS tri, price AS net_tri FROM index_levels WHERE level IS NOT NULL AND session <= DATE '2000-12-31'")),
    Query("ledger_files", "S11 S13 D11", "instrument:s action:s rows:i first:d quantity:1 amount:1 noted:i", ledger_files, with_tables(
        "SELECT instrument, action, count(*) AS rows, min(session) AS first, sum(quantity) AS quantity, sum(CAST(printf('%.4f', price) AS DOUBLE) * quantity) AS amount, count(*) FILTER (note <> '') AS noted FROM trades GROUP BY 1, 2")),
    Query("unusual_numbers", "X17", "priority:s rows:i known:i infinite:i total:2", unusual_numbers, """
SELECT o_orderpriority AS priority, count(*) AS rows, count(*) FILTER (o_orderkey % 11 <> 0) AS known, count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0) AS infinite,
  sum(o_totalprice) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) AS total FROM orders GROUP BY 1"""),
    Query("session_counts", "G13", "symbol:s sessions:i", session_counts, f"""
SELECT {SYMBOL.format('l_suppkey')} AS symbol, count(DISTINCT date_trunc('week', l_shipdate)) AS sessions FROM lineitem GROUP BY 1"""),
    Query("intraday_bars", "D1 ST2 W1", "symbol:s session:d open:4 high:4 low:4 close:4 qty:0 turnover:3 ret:6", intraday, """
SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS ret FROM (SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS session, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS qty, sum(value) AS turnover FROM events GROUP BY 1, 2)"""),
    Query("streamed_bars", "ST2", "symbol:s session:d open:4 high:4 low:4 close:4 mean:6 qty:i", streamed_bars, """
SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS session, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, avg(value) AS mean, count(*) AS qty
FROM events GROUP BY 1, 2"""),
    Query("streamed_first_events", "ST1", "user_id:i event_type:s hour:d", streamed_first, "SELECT DISTINCT user_id, event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM events"),
    Query("streamed_latest_events", "ST1 S15", "user_id:i event_type:s event_id:i value:4", streamed_latest, """
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2"""),
    Query("streamed_stop_alerts", "ST3", "symbol:s day:d l_orderkey:i l_linenumber:i close:6 stop:6 alert:s", streamed_alerts, with_tables(f"""
SELECT * FROM (SELECT c.symbol, c.day, c.l_orderkey, c.l_linenumber, c.close, s.stop, CASE WHEN c.close <= s.stop THEN 'breached' WHEN c.close <= s.stop * 1.03 THEN 'near' END AS alert FROM (
SELECT {SYMBOL.format('l_suppkey')} AS symbol, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, 100.0 * pow(l_extendedprice / l_quantity / 1000, 0.05) AS close FROM lineitem WHERE CAST(l_shipdate AS DATE) > DATE '{STOP_DAY}') c
JOIN (SELECT symbol, arg_max(close, session) * {STOP_SHARE} AS stop FROM bars WHERE session <= DATE '{STOP_DAY}' GROUP BY 1) s ON s.symbol = c.symbol) WHERE alert IS NOT NULL""")),
]
