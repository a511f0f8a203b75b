"""Dates read from print. Impossible dates give NULL; 'today' is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks.functions.text import repair_digits

_RUN = r"[0-9OIlSB]{1,2}\s*[/\-.]\s*[0-9OIlSB]{1,2}\s*[/\-.]\s*[0-9OIlSB]{4}"
_DATE = r"([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*([0-9]{4})"


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(
        F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")
    ).cast("date")


def parse_date(c: Column, today: str) -> Column:
    """First day/month/year run, digits repaired only inside such a run; 1900 to `today`'s year."""
    s = F.coalesce(c, F.lit(""))
    run = F.regexp_substr(s, F.lit(_RUN))
    fixed = F.when(run.isNotNull(), repair_digits(F.upper(run), card=True))
    # a clean date earlier in the text than any repaired run cannot exist: every date is such a run
    g = lambda k: F.regexp_extract(F.coalesce(fixed, s), _DATE, k)
    d = F.when(F.coalesce(fixed, s).rlike(_DATE), _date(g(3), g(2), g(1)))
    return F.when(F.year(d).between(1900, int(today[:4])), d)


def parse_strict_date(c: Column) -> Column:
    """dd/mm/yyyy after look-alike repair and after every other character is dropped."""
    s = F.when(F.coalesce(c, F.lit("")).rlike(r"\d"), F.regexp_replace(repair_digits(c), "[^0-9/]", "")).otherwise("")
    pat = r"([0-9]{2})/([0-9]{2})/([0-9]{4})"
    g = lambda k: F.regexp_extract(s, pat, k)
    return F.when(s.rlike(pat), _date(g(3), g(2), g(1)))


def code_line_date(c: Column, expiry: bool, today: str) -> Column:
    """yymmdd with the century rule: births are not in the future, expiries before 70 are 2000s."""
    ok = c.rlike(r"^[0-9]{6}$")
    yy = F.substring(c, 1, 2).try_cast("int")
    pivot = F.lit(70) if expiry else F.lit(int(today[2:4]) + 1)
    year = F.when(yy < pivot, yy + 2000).otherwise(yy + 1900)
    return F.when(ok, _date(year.cast("string"), F.substring(c, 3, 2), F.substring(c, 5, 2)))
