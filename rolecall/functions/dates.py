"""Date rules. Every rule takes ``as_of``; none reads the clock."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match

# Month names and how many days a unit of age counts.
MONTHS = "january february march april may june july august september october november december".split()
DAYS_PER = {"day": 1, "week": 7, "month": 30}

_MONTH = "|".join(m if m == "may" else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
MONTH_RANGE = rf"(?i)(?:{_MONTH})\s+\d{{4}}\s*-\s*(?:present|current|(?:{_MONTH})\s+\d{{4}})"


def as_date(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def parse_posted(text: Column, as_of: date | str | Column) -> Column:
    """Relative age text ("3 days ago") -> date; anything unreadable is ``as_of``."""
    today = as_date(as_of)
    lowered = F.lower(text)
    number = first_match(lowered, r"\d+").try_cast("bigint")
    has = lambda *words: F.regexp_like(lowered, F.lit("|".join(words)))
    days = F.when(has("hour", "minute", "just now", "today"), 0).when(has("yesterday"), 1)
    for unit, length in DAYS_PER.items():
        days = days.when(has(unit), F.try_multiply(number, F.lit(length)))
    # A date before year 1 can't be meant.
    sound = days.between(0, F.datediff(today, F.lit("0001-01-01").cast("date")))
    return F.date_sub(today, F.when(sound, days).otherwise(0).cast("int"))


def written_date(text: Column) -> Column:
    """Date of "2001-03-05", "March 5, 2001", "5 Mar 2001" or "03/05/2001" (month first); else NULL."""
    plain = F.trim(F.regexp_replace(text.cast("string"), r"(?<=\d)(?:st|nd|rd|th)\b|[.,]", " "))
    word, number = F.lower(first_match(plain, "[A-Za-z]+")), F.regexp_extract_all(plain, F.lit(r"\d+"), F.lit(0))
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.left(word, F.lit(3))).cast("string")
    known = F.regexp_like(word, F.lit(f"^(?:{_MONTH}|sept)$"))
    named = F.regexp_like(plain, F.lit(r"^(?:[A-Za-z]+\s+\d{1,2}\s+\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4})$"))
    parts = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    at = lambda i: F.try_element_at(number, F.lit(i))
    slashed = F.regexp_like(plain, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}$"))
    return F.coalesce(
        text.try_cast("date"), F.when(named & known, parts(at(2), month, at(1))), F.when(slashed, parts(at(3), at(1), at(2)))
    )


def date_age(posted: Column, as_of: date | str | Column) -> Column:
    """``days_since`` of a column that holds dates."""
    today = as_date(as_of)
    return F.greatest(F.datediff(today, F.coalesce(posted, today)), F.lit(0))


def days_since(posted: Column, as_of: date | str | Column) -> Column:
    """Whole days since posting (a date or its text), never negative; unusable dates count as today."""
    return date_age(written_date(posted), as_of)


def age_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "Posted recently")
        .when(days == 0, "Posted today")
        .when(days == 1, "Posted yesterday")
        .when(days.between(2, 6), F.concat(F.lit("Posted "), days.cast("string"), F.lit(" days ago")))
        .when(days.between(7, 13), "Posted a week ago")
        .when(days.between(14, 20), "Posted 2 weeks ago")
        .when(days.between(21, 27), "Posted 3 weeks ago")
        .otherwise("Posted a month ago")
    )


def is_recent(posted: Column, as_of: date | str | Column, days: int = 30) -> Column:
    return posted >= F.date_sub(as_date(as_of), days)


def fetch_time(at: datetime | Column) -> Column:
    stamp = at if isinstance(at, Column) else F.lit(at)
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")


def _month_index(text: Column, strict: bool) -> Column:
    """``year * 12 + month`` of "march 2021"; NULL when it is not a month."""
    name = first_match(F.lower(text), "[a-z]+")
    names = MONTHS if strict else [m[:3] for m in MONTHS]
    month = F.array_position(F.array(*map(F.lit, names)), name if strict else F.left(name, F.lit(3)))
    year = first_match(text, r"\d{4}").try_cast("int")
    return F.when(month > 0, year * 12 + month)


def month_spans(text: Column, as_of: date | str | Column, strict: bool = False) -> Column:
    """Month-year ranges of the work section: ``(start_date, end_date, months)``.

    The work section is the text between the first and second "work experience",
    or all of it. ``strict`` accepts only full month names.
    """
    today = as_date(as_of)
    now = F.year(today) * 12 + F.month(today)
    parts = F.split(text, "work experience")
    section = F.coalesce(F.try_element_at(parts, F.lit(2)), text)
    ranges = F.regexp_extract_all(section, F.lit(MONTH_RANGE), F.lit(0))

    def span(found: Column) -> Column:
        ends = F.split(found, r"\s*-\s*")
        start, end = ends[0], ends[1]
        last = F.when(F.lower(end).isin("present", "current"), now).otherwise(_month_index(end, strict))
        return F.struct(
            start.alias("start_date"),
            end.alias("end_date"),
            (last - _month_index(start, strict)).cast("int").alias("months"),
        )

    return F.filter(F.transform(ranges, span), lambda s: s["months"].isNotNull())


def duration_label(months: Column) -> Column:
    """Label of the raw span: floor division, so a negative span reads "N months"."""
    years, rest = F.floor(months / 12), F.pmod(months, F.lit(12))
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"))
    return F.when(years > 0, plural(years, "years")).when(rest > 0, plural(rest, "months")).otherwise("0 months")


def experience_details(spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start_date"], s["end_date"], duration_label(s["months"]).alias("duration")),
    )


def total_months(spans: Column) -> Column:
    """Sum of the spans, negative ones as 0; overlaps are not merged."""
    return F.aggregate(spans, F.lit(0), lambda acc, s: acc + F.greatest(s["months"], F.lit(0)))
