"""Date parsing and the four-way classification of date texts.

Numeric layouts are rewritten to ISO order and cast: a cast returns null for a bad value, where a
pattern-based parser throws and catches an exception per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtally.spec import FAILED, MISSING, PARSED, TIME_ONLY, DatePolicy

# Fixed value: the text of a bare time of day.
TIME_ONLY_SHAPE = r"^\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"
_VALID_TIME = r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?$"

_TIME = r"([ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?$"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?"
_YEAR_FIRST = rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_TIME}"
_YEAR_LAST = rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}){_TIME}"
# Two-digit years 69..99 belong to the last century.
_SHORT_YEARS = {"20": r"([0-5]\d|6[0-8])", "19": r"(69|[7-9]\d)"}
_WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def _years(first: int, last: int) -> str:
    """Pattern of the four-digit years first..last, whole centuries and decades folded."""
    parts, year = [], first
    while year <= last:
        width = next(w for w in (100, 10, 1) if year % w == 0 and year + w - 1 <= last)
        digits = len(str(width)) - 1
        parts.append(f"{year:04d}"[: 4 - digits] + r"\d" * digits)
        year += width
    return f"(?:{'|'.join(parts)})"


def _iso_text(text: Column, policy: DatePolicy) -> Column:
    """Text of a numeric date in ISO order; empty when the text is no such date."""
    day_month = "$2-$1" if policy.day_first else "$1-$2"
    other = F.regexp_replace(text, _YEAR_LAST, f"$3-{day_month}$4")
    other = F.regexp_replace(other, _YEAR_FIRST, "$1-$2-$3$4")
    for century, years in _SHORT_YEARS.items():
        other = F.regexp_replace(other, rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-]{years}{_TIME}", f"{century}$3-{day_month}$4")
    # Text that begins like an ISO date needs no rewrite.
    ordered = F.when(text.rlike(r"^\d{4}-"), text).otherwise(other)
    return F.regexp_extract(ordered, rf"^{_years(policy.min_year, policy.max_year)}-\d{{1,2}}-\d{{1,2}}{_TIME}", 0)


def _by_format(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def parse_timestamp(text: Column, policy: DatePolicy) -> Column:
    """Zone-less timestamp of a trimmed text, or null; also null outside the years of the policy."""
    years = _years(policy.min_year, policy.max_year)
    half_day = rf"^\d{{1,2}}/\d{{1,2}}/{years} {_CLOCK} [AaPp][Mm]$"
    named = rf"^(\d{{1,2}})[- ]([A-Za-z]{{3}})[a-z]{{0,6}}[- ]({years})( {_CLOCK})?$"
    day_month = "d/M" if policy.day_first else "M/d"
    worded = F.regexp_replace(text, named, "$1-$2-$3$4")
    return F.coalesce(
        _iso_text(text, policy).try_cast("timestamp_ntz"),
        F.when(
            text.rlike(f"{half_day}|{named}"),
            _by_format(worded, f"[{day_month}/yyyy h:mm[:ss] a][d-MMM-yyyy[ H:mm[:ss]]]"),
        ),
        *[_in_years(_by_format(text, pattern), policy) for pattern in policy.extra_formats],
    )


def _in_years(parsed: Column, policy: DatePolicy) -> Column:
    return F.when(F.year(parsed).between(policy.min_year, policy.max_year), parsed)


def date_signature(text: Column) -> Column:
    """Shape of a date text: digit runs become 9, letter runs become a."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "9"), "[A-Za-z]+", "a")


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def is_time_only(text: Column) -> Column:
    return F.coalesce(text.rlike(TIME_ONLY_SHAPE), F.lit(False))


def parse_status(text: Column, parsed: Column) -> Column:
    return (
        F.when(is_blank(text), F.lit(MISSING))
        .when(text.rlike(TIME_ONLY_SHAPE), F.lit(TIME_ONLY))
        .when(parsed.isNotNull(), F.lit(PARSED))
        .otherwise(F.lit(FAILED))
    )


def time_only_hour(text: Column) -> Column:
    """Hour of a bare time. No date is ever attached to it."""
    return F.when(text.rlike(_VALID_TIME), F.split_part(text, F.lit(":"), F.lit(1)).try_cast("int"))


def day_name(day: Column) -> Column:
    names = F.array(*[F.lit(name) for name in _WEEKDAYS])
    # element_at reads a null index of a constant array as the last element.
    return F.when(day.isNotNull(), F.element_at(names, F.dayofweek(day)))


def month_text(day: Column) -> Column:
    return F.substring(day.cast("string"), 1, 7)
