"""Column helpers: null-safe arithmetic, amounts, dates, names, labels. Nothing here raises on bad input; it gives null."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shipping import ship_package


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str, default: float | None = None) -> Column:
    """a / b; the default (null) if either is null or b is 0."""
    out = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def first_of(*columns: Column | str) -> Column:
    """First value that is neither null nor NaN."""
    return F.coalesce(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")) for c in columns])


def pct_change(now: Column | str, before: Column | str) -> Column:
    """Change in percent of the size of the value before."""
    return ratio(col(now) - col(before), F.abs(col(before))) * 100


def to_crore(value: Column | str) -> Column:
    return col(value) / 1e7


def market_cap_crore(mcap: Column | str, shares: Column | str, close: Column | str) -> Column:
    return F.coalesce(col(mcap), col(shares) * col(close)) / 1e7


def amount(raw: Column | str) -> Column:
    """Numbers as written: thousands separators, spaces and currency signs go, (x) is negative; dashes and blanks are null."""
    text = F.trim(col(raw))
    inner = F.regexp_replace(text, r"[,\s₹$]|Rs\.?", "")
    negative = inner.rlike(r"^\(.*\)$")
    number = F.regexp_replace(inner, r"^\(|\)$", "").try_cast("double")
    return F.when(negative, -number).otherwise(number)


def percent(raw: Column | str) -> Column:
    """As amount, with a percent sign allowed at the end."""
    text = F.regexp_replace(F.trim(col(raw)), r"[,%\s]", "")
    return F.when(text.isin("", "-", "--", "NA", "N/A"), None).otherwise(text.try_cast("double"))


#: How dates and months are written, in the order in which they are tried.
DATE_FORMATS = ("d-MMM-yyyy", "d-MMMM-yyyy", "d-M-yyyy", "yyyy-M-d", "d/M/yyyy", "MMM d, yyyy")
PERIOD_FORMATS = ("yyyy-M-d", "yyyy-M", "d/M/yyyy", "d-M-yyyy", "MMM-yy", "MMMM-yyyy", "MMM yyyy", "MMMM yyyy", "yyyyMM", "d-MMM-yyyy")


def any_date(raw: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that fits, as a date. Years of two digits from 69 on are of the last century."""

    def parsed(fmt: str) -> Column:
        at = F.try_to_timestamp(F.trim(col(raw)), F.lit(fmt)).cast("date")
        return F.when(F.year(at) >= 2069, F.add_months(at, -1200)).otherwise(at) if re.search(r"(?<!y)yy(?!y)", fmt) else at

    return F.coalesce(*map(parsed, formats))


def period(raw: Column | str, formats: tuple[str, ...] = PERIOD_FORMATS) -> Column:
    """A month as yyyy-MM."""
    return F.date_format(any_date(raw, formats), "yyyy-MM")


def quarter_label_end(raw: Column | str) -> Column:
    """`Mar 2024` to the last day of that month."""
    return F.last_day(any_date(raw, ("MMM yyyy",)))


def issue_price(price: Column | str, band: Column | str) -> Column:
    """The price if it is a number, else the upper end of the band."""
    numbers = F.regexp_extract_all(F.regexp_replace(col(band), ",", ""), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)
    return F.coalesce(amount(price), F.try_element_at(numbers, F.lit(-1)).try_cast("double"))


@F.pandas_udf(StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """Unicode compatibility decomposition, which Spark has no function for."""
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def normal_name(name: Column | str) -> Column:
    """Decomposed, upper case, everything but A-Z and digits to single spaces. A mark taken off its letter counts as a space.

    Only names beyond ASCII travel to Python; for the others it gets nulls.
    """
    ship_package(SparkSession.active())
    plain = F.coalesce(decomposed(F.when(col(name).rlike(r"[^\x00-\x7F]"), col(name))), col(name))
    return F.trim(F.regexp_replace(F.upper(plain), "[^A-Z0-9]+", " "))


#: What slugs leave out at the end of company names; each is tried once, in this order.
SLUG_TAILS = ("-limited", "-ltd", "-private-limited", "-pvt-ltd", "-india-limited", "-india-ltd", "-corporation", "-company", "-co", "-india")


def dashed(text: Column) -> Column:
    """Letters and digits in lower case, one dash for all between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def slug(name: Column | str) -> Column:
    """Lower case words joined by dashes, & written out, without the usual tails."""
    return reduce(lambda s, tail: F.regexp_replace(s, f"{tail}$", ""), SLUG_TAILS, dashed(F.replace(col(name), F.lit("&"), F.lit(" and "))))


def slug_candidates(name: Column | str) -> Column:
    """All words joined by dashes, as they are and with -ltd and -limited, then without a last ltd or limited and that with -ltd; distinct, none for a name without words."""
    base = dashed(col(name))
    short = F.regexp_replace(base, "-(ltd|limited)$", "")
    tried = F.array(base, F.concat(base, F.lit("-ltd")), F.concat(base, F.lit("-limited")), short, F.concat(short, F.lit("-ltd")))
    return F.when(F.coalesce(base, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(tried))


def fiscal_year(d: Column | str) -> Column:
    """Years from April to March, named by the year they end in."""
    return F.year(F.add_months(col(d), 9))


def fiscal_quarter(d: Column | str) -> Column:
    return F.quarter(F.add_months(col(d), -3))


def fy_label(d: Column | str) -> Column:
    """FY and the year that the date stands in, as statements are labelled by their last day."""
    return F.concat(F.lit("FY"), F.year(col(d)).cast("string"))


def exchange_ticker(symbol: Column | str, series: Column | str) -> Column:
    """SM series trade as SYMBOL-SM.NS, BE as SYMBOL-BE.NS, the others as SYMBOL.NS."""
    s = F.upper(F.trim(col(series)))
    return F.concat(col(symbol).cast("string"), F.when(s.isin("SM", "ST"), "-SM").when(s == "BE", "-BE").otherwise(""), F.lit(".NS"))


def watch_ticker(ticker: Column | str) -> Column:
    """X.NS as NSE:X, X.BO as BSE:X."""
    return F.regexp_replace(F.regexp_replace(col(ticker), r"^(.*)\.NS$", "NSE:$1"), r"^(.*)\.BO$", "BSE:$1")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def points(*conditions: Column) -> Column:
    """How many hold; null counts as not."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("int"), F.lit(0)) for c in conditions])
