"""Experience levels, bands of years and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import blank_to

# Bands of years (min, max).
OPEN_END = 20
ANY_LEVEL = (0, 10)
JUNIOR_LEVEL = (0, 2)
SENIOR_LEVEL = (3, 10)
CATEGORY_BANDS = {"fresher": (0, 2), "experienced": (3, 20)}
ANY_CATEGORY = (0, 20)

_YEARS = r"(\d+)-(\d+)|(\d+)\+"


def _band(low, high) -> Column:
    as_int = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return F.struct(as_int(low).alias("min"), as_int(high).alias("max"))


def parse_band(level: Column) -> Column:
    """Level text -> struct ``(min, max)`` in years."""
    text = F.replace(level, F.lit(" Yrs"), F.lit(""))
    low, high, open_low = (F.regexp_extract(text, _YEARS, g).try_cast("int") for g in (1, 2, 3))
    return (
        F.when(open_low.isNotNull(), _band(open_low, OPEN_END))
        .when(low.isNotNull() & high.isNotNull(), _band(low, high))
        .when(level.contains("Fresher") | level.contains("Entry"), _band(*JUNIOR_LEVEL))
        .when(level.contains("Senior"), _band(*SENIOR_LEVEL))
        .otherwise(_band(*ANY_LEVEL))
    )


def category_band(category: Column) -> Column:
    found = F.when(F.lit(False), _band(*ANY_CATEGORY))
    for name, band in CATEGORY_BANDS.items():
        found = found.when(F.lower(category) == name, _band(*band))
    return found.otherwise(_band(*ANY_CATEGORY))


def bands_overlap(level: Column, category: Column) -> Column:
    """Whether a level and a category share years; a blank side never does."""
    job, user = parse_band(level), category_band(category)
    both = (F.coalesce(level, F.lit("")) != "") & (F.coalesce(category, F.lit("")) != "")
    return both & (user["min"] <= job["max"]) & (user["max"] >= job["min"])


def categorise(years: Column) -> Column:
    return F.when(years <= 1, "Fresher").otherwise("Experienced")


def normalise_level(source: Column, level: Column) -> Column:
    """Year band for the level labels of the detail-page source; others kept."""
    ours = F.lower(source) == dims.LEVEL_SOURCE.lower()
    mapped = F.when(F.lit(False), level)
    for label, band in dims.LEVEL_BANDS.items():
        mapped = mapped.when(ours & (F.lower(level) == label.lower()), F.lit(band))
    return mapped.otherwise(level)


def level_class(level: Column) -> Column:
    """What the category filter can tell apart: ``low`` (0-, 1-), ``other``, ``none``."""
    return F.when(level.isNull(), "none").when(level.like("0-%") | level.like("1-%"), "low").otherwise("other")


#: Level classes the named categories accept; others accept all.
CLASSES = {"fresher": ["low"], "experienced": ["other"]}


def allowed_classes(category: Column) -> Column:
    """Level classes a category accepts."""
    classes = lambda names: F.array(*map(F.lit, names))
    return (
        F.when(F.lower(category) == "fresher", classes(CLASSES["fresher"]))
        .when(F.lower(category) == "experienced", classes(CLASSES["experienced"]))
        .otherwise(classes(["low", "other", "none"]))
    )


def chosen_category(form_level: Column, parsed_level: Column) -> Column:
    """The level stated by the candidate, else the one read from the resume."""
    return blank_to(form_level, parsed_level)


def band_bins(low: Column, high: Column, levels: int) -> Column:
    """Array of ``(level, bin)`` of a band of whole numbers; a bin of level n is 2**n wide.

    A band has the level of its length, where it touches at most two bins, and those of
    all higher levels up to ``levels``. Two bands that share a number share a bin of the
    larger one's level.
    """
    own = F.ceil(F.log2((high - low + 1).cast("double"))).cast("int")
    cell = lambda years, n: F.call_function("shiftright", years, n)
    bins = lambda n: F.sequence(cell(low, n), cell(high, n))
    per_level = lambda n: F.transform(bins(n), lambda b: F.struct(n.alias("level"), b.alias("bin")))
    return F.flatten(F.transform(F.sequence(own, F.greatest(own, F.lit(levels))), per_level))
