"""Column expressions that read text: instruments, trade sentences, corporate actions, auction releases, company pages."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from bartide.functions.numbers import half_even, parse_number

# fixed values: the text formats read here
OPTION_FORMAT = r"^INDEX (\d{4}-\d{2}-\d{2}) (\d+(?:\.\d+)?) (PE|CE)$"
TRADE_FORMAT = r"^(BUY|SELL) (\d+) (.+?) @ ([\d.]+)"
SIGNED_PARAMETER = r"(?i)(X-Amz-(?:Credential|Signature|Security-Token)=)[^&\"'\s<>]+"
AUCTION_DATE = r"Date\s*:\s*([A-Z][a-z]{2} \d{1,2}, \d{4})"
AUCTION_YIELD = r"Cut-off price \(₹\) / Yield.*?\(YTM:\s*([\d.]+)%\)"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def option_parts(instrument) -> Column:
    """Struct (expiry date, strike, kind) of an option name; null for anything else."""
    text = F.trim(F.col(instrument))
    parts = F.struct(F.to_date(_group(text, OPTION_FORMAT, 1)).alias("expiry"),
                     _group(text, OPTION_FORMAT, 2).try_cast("double").alias("strike"), _group(text, OPTION_FORMAT, 3).alias("kind"))
    return F.when(text.rlike(OPTION_FORMAT), parts)


def trade_parts(sentence) -> Column:
    """Struct (action, quantity, instrument, price) of 'BUY 130 X @ 45.10 (2 lots)'; null when it does not match."""
    text = F.col(sentence)
    parts = F.struct(_group(text, TRADE_FORMAT, 1).alias("action"), _group(text, TRADE_FORMAT, 2).try_cast("long").alias("quantity"),
                     _group(text, TRADE_FORMAT, 3).alias("instrument"), _group(text, TRADE_FORMAT, 4).try_cast("double").alias("price"))
    return F.when(text.rlike(TRADE_FORMAT), parts)


def _token_after(tokens: Column, place: Column, step: int) -> Column:
    return F.when(place > 0, F.get(tokens, place - 1 + step))


def _amount_after(tokens: Column, word: str) -> Column:
    """The first number behind a word of a token list."""
    place = F.array_position(tokens, word)
    behind = F.slice(tokens, place.cast("int") + 1, F.size(tokens))
    return F.when(place > 0, F.get(F.filter(behind, lambda t: t.rlike("^[0-9]")), F.lit(0)).try_cast("double"))


def action_parts(subject) -> Column:
    """Struct (kind, factor) of a corporate-action subject: split new/old, bonus b/(a+b), gap (factor from prices);
    null for actions that do not change the price scale.

    The subject is read as a list of words, numbers and colons: a change of face value goes from one amount to another,
    a bonus names its ratio right behind the word, and a reorganisation is told by its words alone."""
    tokens = F.regexp_extract_all(F.lower(F.col(subject)), F.lit(r"[a-z]+|[0-9]+(?:[.][0-9]+)?|:"), F.lit(0))
    said = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    face_value = said.contains(" split") | said.contains(" consolidation ") | said.contains(" sub division ") | said.contains(" subdivision ")
    old, new = _amount_after(tokens, "from"), _amount_after(tokens, "to")
    place = F.array_position(tokens, "bonus").cast("int")
    a, b = (_token_after(tokens, place, k).try_cast("double") for k in (1, 3))
    split = face_value & (old > 0) & (new > 0) & (old != new)
    bonus = (_token_after(tokens, place, 2) == ":") & (a > 0) & (b > 0)
    gap = said.contains(" demerger ") | said.contains(" arrangement ") | said.contains(" composite scheme ")
    return (F.when(split, F.struct(F.lit("split").alias("kind"), (new / F.nullif(old, F.lit(0.0))).alias("factor")))
            .when(bonus, F.struct(F.lit("bonus").alias("kind"), (b / F.nullif(a + b, F.lit(0.0))).alias("factor")))
            .when(gap, F.struct(F.lit("gap").alias("kind"), F.lit(None).cast("double").alias("factor"))))


def redact_signatures(html) -> Column:
    return F.regexp_replace(F.col(html), SIGNED_PARAMETER, "$1REDACTED")


#: names that count without their semicolon too, the longest first, so that the first match is the longest one
BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: what numbers of the old Windows code page and the two special control characters stand for
ODD_NUMBERS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
LAST_POINT = 0x10FFFF


def decoded_entities(text: Column) -> Column:
    """Character references as their characters, in one pass, as HTML 5 reads them: all names of the standard, some of them without a semicolon
    (the longest name counts), decimal and hexadecimal numbers with or without one. What is no reference stays as it is, and what a
    reference opens is not read again.

    The text is cut at each ampersand; a part begins with its reference and is decoded by itself."""
    # names by their first letter, because a map is searched from its beginning
    letters = sorted({name[0] for name in html5})
    names = F.create_map(*[x for a in letters for x in (F.lit(a), F.create_map(*[F.lit(y) for name, chars in sorted(html5.items()) if name[0] == a for y in (name, chars)]))])
    value = lambda name: F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
    odd = F.create_map(*[F.lit(x) for n, chars in ODD_NUMBERS.items() for x in (n, chars)])
    bare = "^(" + "|".join(BARE_NAMES) + ")"
    numeric = r"^#(?:([0-9]+)|[xX]([0-9a-fA-F]+));?"

    def number(part: Column) -> Column:
        decimal, hexadecimal = (F.regexp_replace(F.regexp_extract(part, numeric, k), "^0+(?=.)", "") for k in (1, 2))
        point = F.when(decimal != "", F.when(F.length(decimal) > 8, LAST_POINT + 1).otherwise(decimal.try_cast("int"))).otherwise(
            F.when(F.length(hexadecimal) > 6, LAST_POINT + 1).otherwise(F.conv(hexadecimal, 16, 10).try_cast("int")))
        last = point.bitwiseAND(0xFFFF)
        nothing = point.between(1, 8) | (point == 11) | point.between(14, 31) | (point == 127) | point.between(0xFDD0, 0xFDEF) | (last >= 0xFFFE)
        wide = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(odd, point), F.when((point > LAST_POINT) | point.between(0xD800, 0xDFFF), "\ufffd").when(nothing, "").otherwise(wide))

    def named(part: Column) -> Column:
        whole = F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0)
        short = F.regexp_extract(part, bare, 1)
        rest = lambda name: F.substr(part, F.length(name) + 1)
        return F.coalesce(F.concat(value(whole), rest(whole)), F.when(short != "", F.concat(value(short), rest(short))), F.concat(F.lit("&"), part))

    def decoded(part: Column) -> Column:
        is_number = F.regexp_extract(part, numeric, 0)
        return F.when(is_number != "", F.concat(number(part), F.substr(part, F.length(is_number) + 1))).otherwise(named(part))

    parts = F.split(text, "&")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decoded), ""))


def _after_each(text: Column, opening: str, keep) -> Column:
    """`text` up to the first `opening`, then what `keep` leaves of the part behind each one."""
    parts = F.split(text, opening)
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(rest, lambda part: F.concat(F.lit(" "), keep(part))), ""))


def visible_text(html) -> Column:
    """Text of a page: no scripts and styles, then what stands behind each tag; references decoded, white space as one blank.

    A script that is never closed hides the rest of the page, an unfinished tag what is left of it."""
    shown = _after_each(F.col(html), r"(?i)<(?=(?:script|style)\b)", lambda part: F.regexp_extract(part, r"(?is)</(?:script|style)\s*>(.*)", 1))
    bare = _after_each(shown, "<", lambda part: F.regexp_extract(part, r"(?s)^[^>]*>(.*)", 1))
    return F.regexp_replace(decoded_entities(bare), r"[\s\u00A0]+", " ")


def auction_parts(html) -> Column:
    """Struct (released, yield_pct) of an auction release; null when it is not filled in."""
    def parts(text: Column) -> Column:
        day = F.to_date(F.try_to_timestamp(_group(text, AUCTION_DATE, 1), F.lit("MMM d, yyyy")))
        rate = _group(text, AUCTION_YIELD, 1).try_cast("double")
        return F.struct(day.alias("released"), rate.alias("yield_pct"))

    found = F.transform(F.array(visible_text(html)), parts)  # lists, so that the text is made once
    return F.get(F.filter(found, lambda p: p["released"].isNotNull() & p["yield_pct"].isNotNull()), F.lit(0))


# ---- company pages ------------------------------------------------------------------------------------------------

def section(html: Column, name: str) -> Column:
    return _group(html, rf'(?s)<section id="{name}".*?</section>', 0)


def table_rows(area: Column) -> Column:
    """array<array<string>>: the trimmed td cells of every table row of an HTML fragment."""
    rows = F.regexp_extract_all(area, F.lit(r"(?s)<tr.*?</tr>"), F.lit(0))
    cells = F.transform(rows, lambda row: F.transform(
        F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)),
        lambda cell: F.trim(F.regexp_replace(F.regexp_replace(cell, r"<[^>]+>", ""), "&nbsp;", " "))))
    return F.filter(cells, lambda row: F.size(row) > 0)


def row_numbers(rows: Column, title: str, exact: bool = False) -> Column:
    """Numbers of the first row whose title contains (or is) `title`, unreadable cells as nulls."""

    def titled(row):
        name = F.lower(F.trim(F.regexp_replace(F.get(row, F.lit(0)), r"[ +]+$", "")))
        return name == title if exact else name.contains(title)

    first = F.get(F.filter(rows, titled), F.lit(0))
    return F.transform(F.slice(first, F.lit(2), F.greatest(F.size(first) - 1, F.lit(0))), parse_number)


def last_known(numbers: Column) -> Column:
    return F.get(F.reverse(F.array_compact(numbers)), F.lit(0))


def _last_three(numbers: Column) -> Column:
    return F.slice(F.reverse(F.array_compact(numbers)), 1, 3)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def page_metrics(html: str = "html") -> dict[str, Column]:
    """Fundamentals of a company page as nullable doubles."""
    page = F.col(html)
    ratios, flows = table_rows(section(page, "ratios")), table_rows(section(page, "cash-flow"))
    profit_area = section(page, "profit-loss")
    profit, balance = table_rows(profit_area), table_rows(section(page, "balance-sheet"))
    roce, cash = row_numbers(ratios, "roce"), row_numbers(flows, "operating activity")
    roce3, cash3 = _last_three(roce), _last_three(cash)
    headers = F.regexp_extract_all(profit_area, F.lit(r"(?s)<th[^>]*>(.*?)</th>"), F.lit(1))
    years = F.size(headers) - 1
    # the latest full year: a trailing twelve-month column is skipped
    year = F.when(F.upper(F.trim(F.get(F.reverse(headers), F.lit(0)))) == "TTM", years - 2).otherwise(years - 1)
    interest, before_tax = row_numbers(profit, "interest", True), row_numbers(profit, "profit before tax", True)
    paid, earned = F.get(interest, F.greatest(year, F.lit(0))), F.get(before_tax, F.greatest(year, F.lit(0)))
    cover = F.when(paid == 0, F.lit(float("inf"))).otherwise(half_even((earned + paid) / F.nullif(paid, F.lit(0.0)), 2))
    sales, operating = row_numbers(profit, "sales", True), row_numbers(profit, "operating profit", True)
    last_sales, last_operating = F.get(F.reverse(sales), F.lit(0)), F.get(F.reverse(operating), F.lit(0))
    margin = half_even(last_operating / F.nullif(last_sales, F.lit(0.0)) * 100, 2)
    debt = last_known(row_numbers(balance, "borrowing"))
    equity = last_known(row_numbers(balance, "equity capital")) + last_known(row_numbers(balance, "reserves"))

    items = F.regexp_extract_all(_group(page, r'(?s)<ul id="top-ratios".*?</ul>', 0), F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))

    def ratio_number(name: str) -> Column:
        """The number of the first list item of that name; a three-year figure is another one."""
        title = lambda item: F.lower(F.regexp_extract(item, '(?s)<span class="name">([^<]*)<', 1))
        own = F.get(F.filter(items, lambda item: title(item).contains(name) & ~title(item).contains("3")), F.lit(0))
        return parse_number(_group(own, '(?s)<span class="number">([^<]*)<', 1))

    def growth(name: str) -> Column:
        table = _group(page, rf'(?is)<table class="ranges-table">\s*(?:<tbody>)?\s*<tr>\s*<th[^>]*>\s*[^<]*{name}.*?</table>', 0)
        return F.get(row_numbers(table_rows(table), "3 years"), F.lit(0))

    return {
        "market_cap": ratio_number("market cap"), "current_price": ratio_number("current price"),
        "roce": ratio_number("roce"), "roe": ratio_number("roe"),
        "roce_3yr_avg": F.when(F.size(roce3) > 0, half_even(_total(roce3) / F.nullif(F.size(roce3), F.lit(0)), 2)),
        "operating_cash_flow": last_known(cash), "operating_cash_flow_3yr": F.when(F.size(cash3) == 3, half_even(_total(cash3), 2)),
        "interest_coverage": F.when(year >= 0, cover), "debt_to_equity": F.when(equity > 0, half_even(debt / F.nullif(equity, F.lit(0.0)), 2)),
        "opm": F.coalesce(margin, last_known(row_numbers(profit, "opm"))),
        "sales_growth_3yr": growth("sales growth"), "profit_growth_3yr": growth("profit growth")}
