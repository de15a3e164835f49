"""Written periods as windows of dates (both ends inclusive), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FISCAL_START_MONTH = 4
# Month names by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_YEARS = r"'?(\d{2,4})(?:\s*[-/]\s*(\d{2,4}))?"
_OF = r"\s*[:.]?\s*(?:of\s*)?f?y?\s*"
_QUARTER = r"\bq([1-4])" + _OF + _YEARS
_HALF = r"\b(h1|h2|first half|second half)" + _OF + _YEARS
_MONTH = r"(" + "|".join(MONTHS) + r")[a-z]*\.?,?\s*(?:\d{1,2})?,?\s*(\d{4})"
_SPAN = r"\bf?y?\s*'?(\d{4})\s*[-/]\s*'?(\d{2,4})\b"
_FISCAL = r"\b(?:fy|fiscal(?:\s+year)?)\s*'?(\d{2,4})\b"
_CALENDAR = r"\b(?:cy\s*)?(\d{4})\b"
# Words that make a month with a year the end of what is meant.
_ENDINGS = ("ended", "ending", "as at", "as on", "as of")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _full_year(y: Column) -> Column:
    return F.when(y >= 100, y).when(y < 90, y + 2000).otherwise(y + 1900)


def _end_year(first: Column, second: Column) -> Column:
    """The year in which a fiscal year ends that is written with one year or two."""
    start = _full_year(first)
    rolled = F.floor(start / 100) * 100 + second
    return F.when(second.isNull(), start).when(second >= 100, second).when(rolled < start, rolled + 100).otherwise(rolled).cast("int")


def fiscal_window(end_year: Column, offset: int | Column = 0, months: int = 12, start_month: int = FISCAL_START_MONTH) -> tuple[Column, Column]:
    start = F.add_months(F.make_date(end_year - 1, F.lit(start_month), F.lit(1)), offset)
    return start, F.last_day(F.add_months(start, months - 1))


def parse_period(text: Column, compat: bool = False, start_month: int = FISCAL_START_MONTH) -> Column:
    """struct(label, start, end, granularity, calendar), or null. The first form that fits holds.

    Unless compat, a span's years must follow each other, and a month must be a word of its own.
    """
    month_form = _MONTH if compat else r"\b" + _MONTH
    clean = F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, "[–—]", "-"), r"(?U)\s+", " ")))
    made = lambda window, granularity, calendar: F.struct(window[0].alias("start"), window[1].alias("end"), F.lit(granularity).alias("granularity"), F.lit(calendar).alias("calendar"))
    fiscal = lambda year, offset=0, months=12: fiscal_window(year, offset, months, start_month)
    # Each form is read on its own; a form that is not there gives nulls, and its window is not asked for.
    forms = [_QUARTER, _HALF, month_form, _SPAN, _FISCAL, _CALENDAR]

    def chosen(x: Column) -> Column:
        part = lambda form, group: F.regexp_extract(x["t"], form, group)
        number = lambda form, group: F.try_to_number(F.nullif(part(form, group), F.lit("")), F.lit("9999")).cast("int")
        quarter = made(fiscal(_end_year(number(_QUARTER, 2), number(_QUARTER, 3)), (number(_QUARTER, 1) - 1) * 3, 3), "quarter", "fiscal")
        half = made(fiscal(_end_year(number(_HALF, 2), number(_HALF, 3)), F.when(part(_HALF, 1).isin("h2", "second half"), 6).otherwise(0), 6), "half", "fiscal")
        month = F.array_position(F.lit(MONTHS), part(month_form, 1)).cast("int")
        first = F.make_date(number(month_form, 2), month, F.lit(1))
        year = number(_CALENDAR, 1)
        return (
            F.when(x["form"] == 0, quarter)
            .when(x["form"] == 1, half)
            .when((x["form"] == 2) & (month == 3), made(fiscal(number(month_form, 2)), "year", "fiscal"))
            .when(x["form"] == 2, made((first, F.last_day(first)), "point", "calendar"))
            .when(x["form"] == 3, made(fiscal(_end_year(number(_SPAN, 1), number(_SPAN, 2))), "year", "fiscal"))
            .when(x["form"] == 4, made(fiscal(_full_year(number(_FISCAL, 1))), "year", "fiscal"))
            .when((x["form"] == 5) & year.between(1900, 2100), made((F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))), "year", "calendar"))
        )

    def form(t: Column) -> Column:
        which = F.lit(None).cast("int")
        for i, pattern in reversed(list(enumerate(forms))):
            there = t.rlike(pattern)
            if pattern == month_form:
                said = F.lit(False)
                for w in _ENDINGS:
                    said = said | t.contains(w)
                there = there & said
            if pattern == _SPAN and not compat:
                a, b = F.regexp_extract(t, _SPAN, 1), F.regexp_extract(t, _SPAN, 2)
                there = there & F.coalesce(F.right(b, F.lit(2)) == F.lpad(((F.try_to_number(a, F.lit("9999")) + 1) % 100).cast("int").cast("string"), 2, "0"), F.lit(False)) & ((F.length(b) == 2) | (F.left(b, F.lit(2)) == F.left((F.try_to_number(a, F.lit("9999")) + 1).cast("int").cast("string"), F.lit(2))))
            which = F.when(there, F.lit(i)).otherwise(which)
        return _let(F.struct(t.alias("t"), which.alias("form")), chosen)

    found = _let(clean, form)
    return _let(found, lambda p: F.when(p.isNotNull(), F.struct(F.btrim(text, F.lit(" \t\n\r")).alias("label"), p["start"].alias("start"), p["end"].alias("end"), p["granularity"].alias("granularity"), p["calendar"].alias("calendar"))))


def period_key(period: Column) -> Column:
    return F.when(period.getField("start").isNotNull(), F.concat_ws("..", period.getField("start").cast("string"), period.getField("end").cast("string"))).otherwise(F.lower(period.getField("label")))


def periods_equal(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 == s2) & (e1 == e2)


def periods_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def period_contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= s2) & (e2 <= e1)
