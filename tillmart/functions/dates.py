"""Date parsing and calendar labels."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillmart.functions.text import keep_if

_TIME = r"[T\s]\s*(?:[01]?\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:\.\d+)?)?)?(?:\s?[AaPp][Mm])?(?:Z|[+-]\d\d:?\d\d)?"
_MONTH = (
    r"(Jan(?=uary\b|\b)|Feb(?=ruary\b|\b)|Mar(?=ch\b|\b)|Apr(?=il\b|\b)|May(?=\b)|Jun(?=e\b|\b)|Jul(?=y\b|\b)"
    r"|Aug(?=ust\b|\b)|Sep(?=t\b|tember\b|\b)|Oct(?=ober\b|\b)|Nov(?=ember\b|\b)|Dec(?=ember\b|\b))[a-z]*"
)
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"

# Layouts as steps towards year-month-day; a value that has got there meets no later pattern.
# Numeric layouts with the year last are month first, unless the first number is no month.
_YEAR_LAST_STEPS = (
    (r"^(0?[1-9]|1[0-2])([-/.])(\d{1,2})\2(\d{4})$", "$4-$1-$3"),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$", "$4-$3-$1"),
)
_NUMERIC_STEPS = (
    (r"^(\d{4})([/.])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{4})-(\d{1,2})$", "$1-$2-1"),
    (r"^(\d{4})$", "$1-1-1"),
    (r"^(\d{1,2}([-/.])\d{1,2}\2)([0-6]\d|7[0-5])$", "$120$3"),
    (r"^(\d{1,2}([-/.])\d{1,2}\2)(\d{2})$", "$119$3"),
    *_YEAR_LAST_STEPS,
)
# Layouts with a month name as steps towards day, short month name, year.
_NAMED_STEPS = (
    (rf"(?i)^{_MONTH}\.? (\d{{1,2}}),? (\d{{4}})$", "$2 $1 $3"),
    (rf"(?i)^(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}}|\d{{2}})$", "$1 $2 $3"),
    (rf"(?i)^{_MONTH} (\d{{4}})$", "1 $1 $2"),
    (r"^(\d{1,2} [A-Za-z]{3} )([0-6]\d|7[0-5])$", "$120$2"),
    (r"^(\d{1,2} [A-Za-z]{3} )(\d{2})$", "$119$2"),
)

# The days a nanosecond timestamp can hold; other years count as unparsable.
FIRST_DAY = dt.date(1677, 9, 22)
LAST_DAY = dt.date(2262, 4, 11)


def _rewrite(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def parse_date(text: Column) -> Column:
    """Date in any of the accepted layouts, with or without a time of day, else null.

    The common layouts are told by shape and need one or two rewrites. The others, and
    values with a time, are rewritten step by step to one form and cast once, so no value
    is tried against a date parser per layout. Two-digit years are 2000 to 2075 and 1976
    to 1999.
    """
    day = F.regexp_replace(text, rf"^[\s\p{{Z}}]+|(?:{_TIME})?[\s\p{{Z}}]*$", "")
    numeric = F.regexp_extract(_rewrite(day, _NUMERIC_STEPS), _ISO, 0).try_cast("date")
    named = F.regexp_extract(_rewrite(day, _NAMED_STEPS), r"^\d{1,2} [A-Za-z]{3} \d{4}$", 0)
    parsed = (
        F.when(text.rlike(_ISO), text.try_cast("date"))
        .when(text.rlike(r"^\d{1,2}([-/.])\d{1,2}\1\d{4}$"), _rewrite(text, _YEAR_LAST_STEPS).try_cast("date"))
        .when(text.rlike(r"^\d{4}([/.])\d{1,2}\1\d{1,2}$"), F.translate(text, "/.", "--").try_cast("date"))
        .when(text.rlike("(?i)[a-z]{3}"), F.try_to_date(named, "d MMM yyyy"))
        .otherwise(numeric)
    )
    return keep_if(parsed, lambda date: date.between(F.lit(FIRST_DAY), F.lit(LAST_DAY)))


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def quarter_index(date: Column) -> Column:
    """Quarters since year 0, so that a difference is a number of quarters."""
    return F.year(date) * 4 + F.quarter(date) - 1


def quarter_label(index: Column) -> Column:
    return F.format_string("%04d-Q%d", F.floor(index / 4), F.pmod(index, F.lit(4)) + 1)
