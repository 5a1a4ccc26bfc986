"""SQL for the derived market tables, composed into WITH clauses for the oracle queries."""

from __future__ import annotations

import re

from bartide.sources.market import BOOK_SIZE, CRITERIA

CTES: dict[str, str] = {}


def define(name: str, body: str) -> None:
    CTES[name] = body.strip()


def with_tables(body: str, **extra: str) -> str:
    """Prefix `body` with the CTEs it mentions, in dependency order; keywords add local ones."""
    known = {**CTES, **extra}
    order: list[str] = []

    def visit(text: str, seen: tuple = ()):
        for word in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", text)):
            if word in known and word not in order and word not in seen:
                visit(known[word], (*seen, word))
                order.append(word)

    visit(body)
    if not order:
        return body
    def loops(name: str) -> bool:
        return re.search(rf"\b{name}\b", known[name]) is not None

    parts = ", ".join(f"{n} AS {'' if loops(n) else 'MATERIALIZED '}({known[n]})" for n in order)
    return f"WITH RECURSIVE {parts} {body}"


SYMBOL = "'SYM' || lpad(CAST({} AS VARCHAR), 10, '0')"
PRICE = "100.0 * pow(l_extendedprice / l_quantity / 1000, 0.05)"
AT = f"(l_shipdate, l_orderkey, l_linenumber, l_partkey, {PRICE})"

define("bars", f"""
SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY session) AS prev_close FROM (
  SELECT l_suppkey AS suppkey, {SYMBOL.format('l_suppkey')} AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS session,
    arg_min({PRICE}, {AT}) AS open, max({PRICE}) AS high, min({PRICE}) AS low, arg_max({PRICE}, {AT}) AS close,
    sum(l_quantity) AS qty, sum({PRICE} * l_quantity) AS turnover,
    sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS deliv_qty, count(*) AS trades
  FROM lineitem GROUP BY 1, 2, 3)""")
define("cal", "SELECT session, row_number() OVER (ORDER BY session) AS n FROM (SELECT DISTINCT session FROM bars)")
define("bench", "SELECT session, sum(turnover) / sum(qty) AS bench FROM bars GROUP BY 1")
define("listed", f"""
SELECT {SYMBOL.format('s_suppkey')} AS symbol, s_suppkey AS suppkey, s_name AS company, r_name AS sector, s_acctbal AS acctbal
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
define("books", f"""
SELECT suppkey // {BOOK_SIZE} AS portfolio, symbol, suppkey, value / sum(value) OVER (PARTITION BY suppkey // {BOOK_SIZE}) AS weight
FROM (SELECT suppkey, symbol, sum(turnover) AS value FROM bars GROUP BY 1, 2)""")
define("fund", f"""
SELECT {SYMBOL.format('suppkey')} AS symbol, suppkey, market_cap, CASE WHEN suppkey % 7 <> 0 THEN roce_raw END AS roce, opm,
  CASE WHEN suppkey % 7 <> 0 THEN de_raw END AS debt_to_equity, operating_cash_flow, interest_coverage, pledged_pct,
  (late_value / early_value - 1) * 100 AS sales_growth_3yr, qtr_net_profit,
  (qtr_net_profit - profit_year_ago) / abs(profit_year_ago) * 100 AS qtr_profit_yoy,
  (qtr_sales / sales_year_ago - 1) * 100 AS qtr_sales_yoy
FROM (SELECT l_suppkey AS suppkey, sum(l_extendedprice) / 1e5 AS market_cap, avg(l_discount) * 400 AS roce_raw,
  avg(l_tax) * 300 AS opm, avg(l_quantity) / 25.5 AS de_raw,
  sum(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice ELSE -l_extendedprice END) / 1e5 AS operating_cash_flow,
  avg(l_extendedprice) / 1e4 AS interest_coverage, avg(CASE WHEN l_returnflag = 'R' THEN 100.0 ELSE 0.0 END) AS pledged_pct,
  sum(CASE WHEN l_shipdate >= TIMESTAMP '1998-07-01' THEN l_extendedprice END) AS late_value,
  sum(CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN l_extendedprice END) AS early_value,
  sum(CASE WHEN l_shipdate >= TIMESTAMP '2001-07-01' AND l_shipdate < TIMESTAMP '2001-10-01' THEN l_extendedprice * (l_discount - l_tax / 2) END) / 1e3 AS qtr_net_profit,
  sum(CASE WHEN l_shipdate >= TIMESTAMP '2000-07-01' AND l_shipdate < TIMESTAMP '2000-10-01' THEN l_extendedprice * (l_discount - l_tax / 2) END) / 1e3 AS profit_year_ago,
  sum(CASE WHEN l_shipdate >= TIMESTAMP '2001-07-01' AND l_shipdate < TIMESTAMP '2001-10-01' THEN l_extendedprice END) AS qtr_sales,
  sum(CASE WHEN l_shipdate >= TIMESTAMP '2000-07-01' AND l_shipdate < TIMESTAMP '2000-10-01' THEN l_extendedprice END) AS sales_year_ago
  FROM lineitem GROUP BY 1)""")
define("criteria", "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', {o}, '{f}', '{op}', {t}, '{label}', {str(hard).lower()})" for s, o, f, op, t, label, hard in CRITERIA)
    + ") AS c(sector, ord, field, op, threshold, label, hard)")
define("trades", f"""
SELECT l_suppkey // {BOOK_SIZE} AS portfolio, CAST(date_trunc('week', l_shipdate) AS DATE) AS session,
  CASE WHEN l_linenumber = 7 THEN 'INDEX ' || year(l_shipdate) || '-12-28 ' || CAST(floor(l_discount * 100) + 95 AS BIGINT) || ' '
    || CASE WHEN l_partkey % 3 = 0 THEN 'CE' ELSE 'PE' END ELSE {SYMBOL.format('l_suppkey')} END AS instrument,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS action, l_quantity AS quantity,
  CASE WHEN l_linenumber = 7 THEN {PRICE} / 20 ELSE {PRICE} END AS price,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ref, CASE WHEN l_linenumber <> 7 AND l_returnflag = 'R' AND l_orderkey % 6 = 0 THEN 'stop-loss exit; proceeds parked in the liquid ETF'
    WHEN l_linenumber <> 7 AND l_returnflag <> 'R' AND l_orderkey % 40 = 0 THEN 'redeploys ' || {SYMBOL.format('l_suppkey')} || chr(39) || 's parked proceeds: replaces it' ELSE '' END AS note
FROM lineitem WHERE l_linenumber IN (1, 7)""")
define("factors", """
SELECT w.session, market, large, bond, 1000.0 * exp(sum(0.0008 + delivered * 0.0004) OVER (ORDER BY w.session)) AS rate
FROM (SELECT session, sum(turnover) / sum(qty) AS market,
    sum(turnover * CASE WHEN suppkey % 3 = 0 THEN 1.0 ELSE 0.0 END) / sum(qty * CASE WHEN suppkey % 3 = 0 THEN 1.0 ELSE 0.0 END) AS large,
    sum(deliv_qty) / sum(qty) AS delivered FROM bars GROUP BY 1) w
LEFT JOIN (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS session, 100.0 * pow(avg(o_totalprice) / 200000, 0.2) AS bond
  FROM orders GROUP BY 1) o ON o.session = w.session""")
define("foreign_closes", """
SELECT CAST(o_orderdate AS DATE) AS day, 80.0 * pow(avg(o_totalprice) / 200000, 0.1) AS close FROM orders GROUP BY 1""")
define("chain", """
SELECT l.underlying, DATE '2001-11-05' AS trade_date, expiry, strike, kind, spot,
  greatest(CASE WHEN kind = 'CE' THEN spot - strike ELSE strike - spot END, 0.0) + spot * (0.01 + mean_size / 1000) AS settle, oi, contracts
FROM (SELECT p_brand AS underlying, CAST(DATE '2001-12-28' + to_months(CAST(p_size % 3 AS INTEGER)) AS DATE) AS expiry,
    floor(p_retailprice / 25) * 25.0 AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'PE' ELSE 'CE' END AS kind,
    sum(CAST(p_size AS DOUBLE)) AS oi, avg(p_size) AS mean_size, count(*) AS contracts FROM part GROUP BY 1, 2, 3, 4) l
JOIN (SELECT p_brand AS underlying, avg(p_retailprice) AS spot FROM part GROUP BY 1) s ON s.underlying = l.underlying""")

# bars on the full calendar between a symbol's first and last session, gaps as nulls
define("numbered", "SELECT b.*, c.n FROM bars b JOIN cal c ON c.session = b.session")
define("grid", """
SELECT s.symbol, s.suppkey, c.n, c.session, b.open, b.high, b.low, b.close, b.qty, b.turnover, b.deliv_qty, b.prev_close
FROM (SELECT symbol, suppkey, min(n) AS lo, max(n) AS hi FROM numbered GROUP BY 1, 2) s JOIN cal c ON c.n BETWEEN s.lo AND s.hi
LEFT JOIN numbered b ON b.symbol = s.symbol AND b.n = c.n""")
# inputs of the oscillators: row number, changes, true range (previous row and exchange close), directional moves
define("osc_in", """
SELECT symbol, session, high, low, close, prev_close, rn, total, greatest(close - pc, 0.0) * CASE WHEN pc IS NULL THEN NULL ELSE 1 END AS gain,
  CASE WHEN pc IS NULL THEN NULL ELSE greatest(pc - close, 0.0) END AS loss,
  greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS mdm
FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS total, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session))""")
define("osc", """
SELECT symbol, 14::BIGINT AS rn, avg(gain) AS gain, avg(loss) AS loss, avg(tr) AS tr, avg(pdm) AS pdm, avg(mdm) AS mdm
FROM osc_in WHERE rn <= 14 AND total >= 14 GROUP BY 1
UNION ALL
SELECT i.symbol, i.rn, (o.gain * 13 + i.gain) / 14, (o.loss * 13 + i.loss) / 14, (o.tr * 13 + i.tr) / 14,
  (o.pdm * 13 + i.pdm) / 14, (o.mdm * 13 + i.mdm) / 14
FROM osc o JOIN osc_in i ON i.symbol = o.symbol AND i.rn = o.rn + 1""")
define("dmi_in", """
SELECT *, CASE WHEN plus_di + minus_di > 0 THEN 100.0 * abs(plus_di - minus_di) / (plus_di + minus_di) ELSE 0.0 END AS dx FROM (
SELECT i.symbol, i.session, i.rn, i.total, i.close, o.gain, o.loss, o.tr AS atr, CASE WHEN o.tr > 0 THEN 100.0 * o.pdm / o.tr ELSE 0.0 END AS plus_di,
  CASE WHEN o.tr > 0 THEN 100.0 * o.mdm / o.tr ELSE 0.0 END AS minus_di
FROM osc_in i LEFT JOIN osc o ON o.symbol = i.symbol AND o.rn = i.rn)""")
define("adx_rec", """
SELECT symbol, 14::BIGINT AS rn, avg(dx) AS adx FROM dmi_in WHERE rn <= 14 AND total >= 14 GROUP BY 1
UNION ALL SELECT i.symbol, i.rn, (a.adx * 13 + i.dx) / 14 FROM adx_rec a JOIN dmi_in i ON i.symbol = a.symbol AND i.rn = a.rn + 1""")
define("tech", """
SELECT d.symbol, d.session, d.rn, d.total, d.close, d.atr, d.plus_di, d.minus_di, d.dx, a.adx,
  CASE WHEN d.total < 15 THEN NULL WHEN d.gain = 0 AND d.loss = 0 THEN 50.0 WHEN d.loss = 0 THEN 100.0 WHEN d.gain = 0 THEN 0.0
    ELSE 100.0 - 100.0 / (1.0 + d.gain / d.loss) END AS rsi,
  CASE WHEN a.adx IS NULL THEN 'N/A (Insufficient History)' WHEN d.plus_di > d.minus_di THEN 'Bullish (Uptrend)'
    WHEN d.minus_di > d.plus_di THEN 'Bearish (Downtrend)' ELSE 'Neutral' END AS trend
FROM dmi_in d LEFT JOIN adx_rec a ON a.symbol = d.symbol AND a.rn = d.rn""")
# true range on the exchange's previous close, for the stop
define("atr_rec", """
SELECT symbol, 14::BIGINT AS rn, avg(etr) AS atr FROM etr_in WHERE rn <= 14 AND total >= 14 GROUP BY 1
UNION ALL SELECT i.symbol, i.rn, (a.atr * 13 + i.etr) / 14 FROM atr_rec a JOIN etr_in i ON i.symbol = a.symbol AND i.rn = a.rn + 1""")
define("etr_in", """
SELECT symbol, rn, total, greatest(high - low, coalesce(abs(high - prev_close), 0), coalesce(abs(low - prev_close), 0)) AS etr FROM osc_in""")
define("last_atr", "SELECT a.symbol, a.atr FROM atr_rec a JOIN osc_in i ON i.symbol = a.symbol AND i.rn = a.rn WHERE a.rn = i.total")
define("levels", """
SELECT symbol, current_price, coalesce(support, CASE WHEN min_low < current_price THEN round_even(min_low, 2) ELSE round_even(current_price * 0.95, 2) END) AS support,
  coalesce(resistance, CASE WHEN max_high > current_price THEN round_even(max_high, 2) END) AS resistance, total FROM (
SELECT symbol, any_value(last_close) AS current_price, max(CASE WHEN lo < last_close THEN lo END) AS support,
  min(CASE WHEN hi > last_close THEN hi END) AS resistance, min(low) AS min_low, max(high) AS max_high, count(*) AS total
FROM (SELECT symbol, low, high, last_value(close) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_close,
    CASE WHEN count(*) OVER w >= 5 THEN round_even(min(low) OVER w, 2) END AS lo, CASE WHEN count(*) OVER w >= 5 THEN round_even(max(high) OVER w, 2) END AS hi
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) GROUP BY symbol) WHERE total >= 5""")
# stock and benchmark on paired sessions, counted back from the latest (d = 0)
define("paired", """
SELECT b.symbol, b.session, b.close, m.bench, row_number() OVER (PARTITION BY b.symbol ORDER BY b.session DESC) - 1 AS d,
  count(*) OVER (PARTITION BY b.symbol) AS total FROM bars b JOIN bench m ON m.session = b.session""")


def spread_sql(rows: int) -> str:
    """Latest RS over `rows` paired sessions, the window shrinking to the history (rs, ret, bench_ret)."""
    return f"""SELECT symbol, round_even(((p1 - p0) / p0) * 100 - ((m1 - m0) / m0) * 100, 2) AS rs, round_even((p1 - p0) / p0 * 100, 2) AS ret,
  round_even((m1 - m0) / m0 * 100, 2) AS bench_ret FROM (
  SELECT symbol, max(CASE WHEN d = 0 THEN close END) AS p1, max(CASE WHEN d = least({rows}, total - 1) THEN close END) AS p0,
    max(CASE WHEN d = 0 THEN bench END) AS m1, max(CASE WHEN d = least({rows}, total - 1) THEN bench END) AS m0
  FROM paired WHERE total >= 2 GROUP BY 1)"""


def offset_sql(rows: int) -> str:
    """RS over exactly `rows` sessions for every window end (symbol, d, rs, ret)."""
    return f"""SELECT symbol, session, d, round_even((close / p0 - 1) * 100 - (bench / m0 - 1) * 100, 2) AS rs, round_even((close / p0 - 1) * 100, 2) AS ret
  FROM (SELECT *, lag(close, {rows}) OVER w AS p0, lag(bench, {rows}) OVER w AS m0 FROM paired WINDOW w AS (PARTITION BY symbol ORDER BY session))"""


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


define("raw_actions", f"""
SELECT {SYMBOL.format('l_suppkey')} AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ex_date, l_orderkey * 1000000 + l_partkey AS ord,
  CASE l_partkey % 4 WHEN 0 THEN 'split' WHEN 1 THEN 'bonus' WHEN 2 THEN 'gap' END AS kind,
  CASE l_partkey % 4 WHEN 0 THEN 2.0::DOUBLE / 10.0 WHEN 1 THEN 2.0::DOUBLE / 3.0 END AS factor
FROM lineitem WHERE l_linenumber = 3 AND l_quantity >= 49""")
define("actions", "SELECT * FROM raw_actions WHERE kind IS NOT NULL")
define("day_factors", """
SELECT a.symbol, a.ex_date AS session, CASE WHEN max(g.last_gap) IS NOT NULL THEN any_value(b.close / b.prev_close) ELSE 1.0 END
  * coalesce(product(CASE WHEN a.ord > coalesce(g.last_gap, -1) THEN a.factor END), 1.0) AS factor
FROM actions a JOIN (SELECT symbol, ex_date, max(CASE WHEN kind = 'gap' THEN ord END) AS last_gap FROM actions GROUP BY 1, 2) g
  ON g.symbol = a.symbol AND g.ex_date = a.ex_date
JOIN osc_in b ON b.symbol = a.symbol AND b.session = a.ex_date WHERE b.rn > 1 GROUP BY 1, 2""")
define("adjusted", """
SELECT symbol, suppkey, session, open * scale AS open, high * scale AS high, low * scale AS low, close * scale AS close, qty / scale AS qty,
  deliv_qty / scale AS deliv_qty, turnover, prev_close * scale * own AS prev_close
FROM (SELECT b.*, coalesce(f.factor, 1.0) AS own, coalesce(product(coalesce(f.factor, 1.0)) OVER (PARTITION BY b.symbol ORDER BY b.session
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS scale
  FROM bars b LEFT JOIN day_factors f ON f.symbol = b.symbol AND f.session = b.session)""")
define("index_levels", """
SELECT index_name, session, CASE WHEN weekofyear(session) % 26 <> 0 THEN p END AS price, CASE WHEN weekofyear(session) % 9 <> 0 THEN p * 1.5 END AS level
FROM (SELECT sector AS index_name, session, sum(turnover) / sum(qty) AS p FROM bars JOIN listed USING (symbol) GROUP BY 1, 2)""")


def calendar_sql(start: str, end: str) -> str:
    from bartide.sources.market import EXTRA_SESSIONS, HOLIDAYS

    return f"""SELECT day, open_day AS is_session, sum(CASE WHEN open_day THEN 1 ELSE 0 END) OVER (ORDER BY day) AS sessions_so_far,
  last_value(CASE WHEN open_day THEN day END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_session
  FROM (SELECT day, (isodow(day) <= 5 OR CAST(day AS VARCHAR) IN ({_quoted(EXTRA_SESSIONS)})) AND CAST(day AS VARCHAR) NOT IN ({_quoted(HOLIDAYS)}) AS open_day
    FROM (SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS DATE) AS day))"""
