"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NOT_AVAILABLE = "Not Available"
NOT_FOUND = "Not found"

_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))

# What the text rules look for.
EMAIL = r"(?<![\p{L}\p{N}_.-])[\p{L}\p{N}_.-]++@[\p{L}\p{N}_.-]+"
PHONE = r"\+?[0-9]{10,12}|\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
ROLE_WORDS = "developer|engineer|analyst|manager|scientist|architect|intern"
JOB_TYPES = "Full Time|Part Time|Contract|Permanent|Internship"


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.trim(col, F.lit(_SPACES))


def normalise(col: Column) -> Column:
    return F.lower(strip(col))


def blank_to(col: Column, default: str | Column) -> Column:
    """``default`` where the text is NULL or blank."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(strip(col) != "", col).otherwise(fallback)


def first_match(col: Column, pattern: str) -> Column:
    """First match of the whole pattern, NULL without one."""
    return F.regexp_substr(col, F.lit(pattern))


def first_group(col: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL without a match."""
    return F.when(F.regexp_like(col, F.lit(pattern)), F.regexp_extract(col, pattern, 1))


def email(col: Column) -> Column:
    return F.coalesce(first_match(col, EMAIL), F.lit(NOT_FOUND))


def phone(col: Column) -> Column:
    return F.coalesce(first_match(col, PHONE), F.lit(NOT_FOUND))


def person_name(col: Column) -> Column:
    """First run of words and spaces in the first line."""
    line = F.substring_index(col, "\n", 1)
    return blank_to(strip(first_match(line, r"[\p{L}\p{N}_\s]+")), "Unknown")


def role_phrases(col: Column) -> Column:
    """Distinct phrases that end in a role word.

    A phrase reaches from the start of a run of letters, spaces and hyphens to
    the last role word of the run. Taking the runs first keeps the work linear in
    the text; the extra character tells whether the run ends at a word boundary.
    """
    runs = F.regexp_extract_all(F.translate(col, "\n", " "), F.lit(rf"[a-zA-Z\s-]++{WORD}?"), F.lit(0))
    phrase = lambda run: F.regexp_extract(run, rf"(?i)^([a-zA-Z\s-]*(?:{ROLE_WORDS}))(?!{WORD})", 1)
    phrases = F.transform(F.filter(runs, lambda r: phrase(r) != ""), lambda r: normalise(phrase(r)))
    return F.array_distinct(phrases)


_DEGREE = r"[bm]\.(?:tech|sc|s)|ph\.d|(?:bachelor|master|doctorate)\s+of"
# A field ends before an institution, a range of years, the next punctuation mark or the line's end.
_FIELD_END = r"\s*(?:\b(?:university|college|institute)\b|\d{4}\s*-\s*\d{4}|[^\p{L}\p{N}_\s-]|\n|$)"
_EDUCATION = rf"(?i)({_DEGREE})[^\S\n]*([\p{{L}}\p{{N}}_ \t-]*?)(?={_FIELD_END})"


def education(col: Column) -> Column:
    """Array of ``(degree, field)``."""
    degrees = F.regexp_extract_all(col, F.lit(_EDUCATION), F.lit(1))
    fields = F.regexp_extract_all(col, F.lit(_EDUCATION), F.lit(2))
    return F.zip_with(
        degrees,
        fields,
        lambda d, f: F.struct(strip(d).alias("degree"), blank_to(strip(f), "Unknown").alias("field")),
    )


def slug(col: Column) -> Column:
    return F.lower(F.replace(col, F.lit(" "), F.lit("_")))


def slug_from_hyphens(col: Column) -> Column:
    return F.replace(col, F.lit("-"), F.lit("_"))


def search_term(col: Column) -> Column:
    return F.replace(col, F.lit("_"), F.lit("%20"))


def first_number(col: Column) -> Column:
    """First integer, thousands commas allowed; 0 without one."""
    digits = F.replace(first_match(col, r"[0-9]{1,3}(?:,[0-9]{3})+(?![0-9])|[0-9]+"), F.lit(","), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def job_type_from_text(description: Column) -> Column:
    """Labelled employment type, else the first known type named in the text."""
    labelled = strip(first_group(description, r"(?i)Employment Type:\s*([^,\n;]+)"))
    named = first_match(description, rf"(?i)(?:{JOB_TYPES})")
    found = F.coalesce(labelled, named, F.lit(NOT_AVAILABLE))
    return F.when(description == NOT_AVAILABLE, F.lit(NOT_AVAILABLE)).otherwise(found)


def joined_skills(skills: Column) -> Column:
    return F.when(F.size(skills) > 0, F.array_join(skills, ", ")).otherwise(F.lit(NOT_AVAILABLE))


def score_label(score: Column) -> Column:
    return F.format_string("%.2f", F.coalesce(score.cast("double"), F.lit(0.0)))


def overflow_label(items: Column, shown: int = 5) -> Column:
    """``+N more`` beyond the items shown, else NULL."""
    extra = F.size(items) - shown
    return F.when(extra > 0, F.concat(F.lit("+"), extra.cast("string"), F.lit(" more")))
