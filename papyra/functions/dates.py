"""Dates: two-digit years of machine-readable zones, dates in text, expiry. The clock is a parameter, as_of."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.config import SOON_DAYS

from .text import EDGE, constant_map, let

#: Names of months in documents.
MONTHS = {
    "JAN": "01", "JANUARY": "01", "FEB": "02", "FEBRUARY": "02", "MAR": "03", "MARS": "03", "MARCH": "03", "APR": "04", "APRIL": "04",
    "MAY": "05", "MAI": "05", "JUN": "06", "JUNE": "06", "JUL": "07", "JULY": "07", "AUG": "08", "AUGUST": "08", "SEP": "09", "SEPTEMBER": "09",
    "OCT": "10", "OCTOBER": "10", "NOV": "11", "NOVEMBER": "11", "DEC": "12", "DECEMBER": "12",
}

EXPIRY = "struct<expired:boolean,status:string,daysUntilExpiry:int,daysExpired:int>"


def mrz_date(value: Column, mode: str, as_of: dt.date) -> Column:
    """yyMMdd as ISO text, '' if it isn't six digits.

    birth: years after as_of's belong to the 1900s. expiry: the century at hand, or the next if that is over five years past.
    """
    yy = F.substring(value, 1, 2).cast("int")
    if mode == "expiry":
        base = as_of.year // 100 * 100
        year = F.when(base + yy < as_of.year - 5, base + yy + 100).otherwise(base + yy)
    else:
        year = F.when(yy > as_of.year % 100, 1900 + yy).otherwise(2000 + yy)
    text = F.concat(year.cast("string"), F.lit("-"), F.substring(value, 3, 2), F.lit("-"), F.substring(value, 5, 2))
    return F.when(F.coalesce(value, F.lit("")).rlike(r"^[0-9]{6}\z"), text).otherwise("")


def is_date(value: Column, mode: str | None = None, as_of: dt.date | None = None) -> Column:
    """ISO text of a day that exists; births from 1900 to as_of's year, expiries within 30 years of it."""
    shaped = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    year = F.substring(value, 1, 4).cast("int")
    if mode == "birth":
        shaped = shaped & year.between(1900, as_of.year)
    if mode == "expiry":
        shaped = shaped & year.between(as_of.year - 30, as_of.year + 30)
    return F.coalesce(shaped, F.lit(False))


def expiry_status(value: Column, as_of: dt.date) -> Column:
    """struct(expired, status, daysUntilExpiry, daysExpired) of ISO text; UNKNOWN if it isn't a day."""

    def told(left: Column) -> Column:
        status = F.when(left.isNull(), "UNKNOWN").when(left < 0, "EXPIRED").when(left <= SOON_DAYS, "EXPIRING_SOON").otherwise("VALID")
        return F.struct(F.coalesce(left < 0, F.lit(False)).alias("expired"), status.alias("status"), F.when(left >= 0, left).alias("daysUntilExpiry"), F.when(left < 0, -left).alias("daysExpired")).cast(EXPIRY)

    return let(F.datediff(F.when(is_date(value), F.try_to_date(value, "yyyy-MM-dd")), F.lit(as_of)), told)


def _year(y: Column) -> Column:
    """Two digits over 40 are of the 1900s."""
    return F.when(F.length(y) == 2, F.concat(F.when(y.cast("int") > 40, "19").otherwise("20"), y)).otherwise(y)


def _joined(y: Column, m: Column, d: Column) -> Column:
    return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))


def month_number(name: Column) -> Column:
    return F.coalesce(F.try_element_at(constant_map(MONTHS), F.upper(name)), F.lit(""))


def _iso(text: Column, sep: str, edge: str) -> tuple[Column, Column]:
    p = rf"{edge}([0-9]{{4}}){sep}([0-9]{{1,2}}){sep}([0-9]{{1,2}}){edge}"
    return text.rlike(p), _joined(F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 3))


def _dmy(text: Column, sep: str, edge: str) -> tuple[Column, Column]:
    p = rf"{edge}([0-9]{{1,2}}){sep}([0-9]{{1,2}}){sep}([0-9]{{2,4}}){edge}"
    return text.rlike(p), _joined(_year(F.regexp_extract(text, p, 3)), F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 1))


def _worded(text: Column, edge: str) -> tuple[Column, Column]:
    p = rf"{edge}([0-9]{{1,2}})\s+([A-Z]{{3,9}})\s+([0-9]{{2,4}}){edge}"
    month = month_number(F.regexp_extract(text, p, 2))
    return text.rlike(p), F.when(month == "", "").otherwise(_joined(_year(F.regexp_extract(text, p, 3)), month, F.regexp_extract(text, p, 1)))


def secondary_date(value: Column) -> Column:
    """The date in a line of a secondary document: Y-M-D, else D-M-Y, else day month year in words."""
    text = F.upper(F.coalesce(value, F.lit("")))
    (a, x), (b, y), (c, z) = _iso(text, r"[/\-.]", EDGE), _dmy(text, r"[/\-.]", EDGE), _worded(text, EDGE)
    return F.when(a, x).when(b, y).when(c, z).otherwise("")


def primary_date(value: Column) -> Column:
    """The date in text found on a primary document: in words, else Y-M-D, else D-M-Y; dots don't separate."""
    text = F.trim(F.upper(F.coalesce(value, F.lit(""))))
    (a, x), (b, y), (c, z) = _worded(text, ""), _iso(text, "[/-]", ""), _dmy(text, "[/-]", "")
    return F.when(a, x).when(b, y).when(c, z).otherwise("")


def visa_date(value: Column) -> Column:
    """D-M-Y only."""
    text = F.trim(F.coalesce(value, F.lit("")))
    a, x = _dmy(text, r"[/\-.]", "")
    return F.when(a, x).otherwise("")


def residence_date(value: Column) -> Column:
    """Y-M-D, else D-M-Y."""
    text = F.trim(F.coalesce(value, F.lit("")))
    (a, x), (b, y) = _iso(text, r"[/\-.]", ""), _dmy(text, r"[/\-.]", "")
    return F.when(a, x).when(b, y).otherwise("")
