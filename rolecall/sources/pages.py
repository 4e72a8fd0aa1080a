"""Posting pages: detail pages, listing cards and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, html as h, text as t
from ..operators.skills import bounded_dictionary, extract_skills_by_join, skills_in

# Selectors (tag, class) in the order they are tried, and defaults.
DETAIL_SOURCE = "LinkedIn"
DETAIL_FIELDS = {
    "job_title": [("h1", "top-card-layout__title"), ("h1", None)],
    "company": [
        ("a", "topcard__org-name-link"),
        ("span", "topcard__flavor"),
        ("span", "jobs-top-card__company-title"),
    ],
    "location": [("span", "topcard__flavor--bullet"), ("span", "jobs-unified-top-card__bullet")],
    "posted_text": [("span", "posted-time-ago__text"), ("span", "jobs-unified-top-card__posted-date")],
    "applicants_text": [("span", "num-applicants__caption"), ("span", "jobs-unified-top-card__applicant-count")],
    "salary": [("span", "topcard__flavor--salary"), ("span", "jobs-unified-top-card__salary")],
    "job_description": [("div", "show-more-less-html__markup"), ("div", "jobs-description__content")],
    "experience_level": [
        ("span", "description__job-criteria-text"),
        ("span", "jobs-unified-top-card__experience-level"),
    ],
}
DETAIL_DEFAULTS = {
    "job_title": "Not Available",
    "company": "Not Available",
    "location": "Not Available",
    "posted_text": "Not Available",
    "salary": "Not disclosed",
    "job_description": "Not Available",
    "experience_level": "Not Available",
}
CRITERIA_ITEMS = [("li", "description__job-criteria-item"), ("li", "jobs-unified-top-card__job-insight")]
CRITERIA_LABEL = ("h3", "description__job-criteria-subheader")
CRITERIA_VALUE = ("span", "description__job-criteria-text")
CRITERIA_NAME = "employment type"

LISTING_SOURCE = "Naukri"
CARD = ("div", "srp-jobtuple-wrapper")
CARD_TITLE = ("a", "title")
CARD_TAG = ("li", "tag-li")
CARD_FIELDS = {
    "job_title": [CARD_TITLE],
    "company": [("a", "comp-name")],
    "location": [("span", "locWdth")],
    "salary": [("span", "sal")],
    "experience_level": [("span", "exp")],
    "posted_text": [("span", "job-post-day")],
}
CARD_DEFAULTS = {
    "company": "Unknown",
    "location": "Not Available",
    "salary": "Not Disclosed",
    "experience_level": "Not Available",
}
CARD_DESCRIPTION = {"job_description": [("section", "styles_job-desc-container__txpYf")]}
APPLICANTS_LABEL = "Applicants:"

LINK_CARD = ("div", "base-card")
LINK = ("a", "base-card__full-link")


def _defaults(values: dict[str, str]) -> dict[str, Column]:
    return {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}


def _first_inner(markup: Column, *selectors: tuple[str, str | None]) -> Column:
    return F.coalesce(*[h.once(h.after(markup, tag, cls), lambda rest, tag=tag: h.inner(rest, tag)) for tag, cls in selectors])


def _with_criteria_job_type(df: DataFrame) -> DataFrame:
    """Adds ``job_type``: inner HTML of the first criteria value whose label names the employment type."""
    page, items = F.col("_page"), F.col("_items")
    names = lambda text: F.coalesce(F.lower(h.without_tags(text)).contains(CRITERIA_NAME), F.lit(False))
    label = lambda item: _first_inner(item, CRITERIA_LABEL, ("span", None))
    value = lambda item: _first_inner(item, CRITERIA_VALUE, ("span", None))
    df = df.withColumn("_items", h.elements(page, *CRITERIA_ITEMS[0]))
    df = df.withColumn("_items", F.when(F.size(items) > 0, items).otherwise(h.elements(page, *CRITERIA_ITEMS[1])))
    # An item whose label names the type names it somewhere; the label is looked up only there.
    labelled = F.filter(F.filter(items, names), lambda item: names(label(item)))
    values = F.filter(F.transform(labelled, value), lambda v: v.isNotNull())
    return df.withColumn("job_type", F.try_element_at(values, F.lit(1))).drop("_items")


def _with_skills(df: DataFrame, skills: DataFrame, key: str) -> DataFrame:
    """Adds ``skills_required`` from the description."""
    described = df.withColumn("_text", F.nullif("job_description", F.lit(t.NOT_AVAILABLE)))
    phrases = bounded_dictionary(skills)
    if phrases is None:
        found = extract_skills_by_join(described, skills, "_text", key, "_skills")
    else:
        found = described.withColumn("_skills", skills_in(F.col("_text"), phrases))
    return found.withColumn("skills_required", t.joined_skills(F.col("_skills"))).drop("_text", "_skills")


def extract_detail_pages(pages: DataFrame, skills: DataFrame, as_of) -> DataFrame:
    """One posting per detail page. ``pages`` has ``page_id, url, role, html``."""
    read = pages.withColumn("_page", h.visible(F.col("html"))).drop("html")
    read = h.read_texts(read, "_page", DETAIL_FIELDS)
    # Without an applicants element, any text such as "25 applicants" counts.
    stray = r"(?i)>([^<>]*?\d\s*(?:applicants|applied)[^<>]*)<"
    read = (
        _with_criteria_job_type(read)
        .withColumn("_stray", F.when(F.col("applicants_text").isNull(), t.first_group(F.col("_page"), stray)))
        .drop("_page")
        .withColumn("job_type", F.coalesce(h.text_of(F.col("job_type")), F.lit(t.NOT_AVAILABLE)))
        .withColumns(_defaults(DETAIL_DEFAULTS))
        .withColumn("applicants", t.first_number(F.coalesce("applicants_text", "_stray")))
        .withColumn("posted_date", dates.parse_posted(F.col("posted_text"), as_of))
        .withColumnRenamed("url", "job_link")
        .withColumn("source", F.lit(DETAIL_SOURCE))
        .drop("applicants_text", "posted_text", "_stray")
    )
    return _with_skills(read, skills, "page_id")


def detail_keys(pages: DataFrame) -> DataFrame:
    """``page_id, job_title, company, source`` of detail pages, as ``extract_detail_pages`` reads them."""
    names = ("job_title", "company")
    read = pages.select("page_id", h.visible(F.col("html")).alias("_page"))
    read = h.read_texts(read, "_page", {c: DETAIL_FIELDS[c] for c in names})
    read = read.withColumns(_defaults({c: DETAIL_DEFAULTS[c] for c in names}))
    return read.select("page_id", *names, F.lit(DETAIL_SOURCE).alias("source"))


def extract_cards(pages: DataFrame, as_of) -> DataFrame:
    """One row per card of a listing page; ``pages`` has ``page_id, role, page, html``.

    A card needs a title with a link and an age; others are skipped. ``pos`` is
    the card's place on its page.
    """
    tag, cls = CARD
    cards = (
        pages.select("page_id", "role", "page", h.visible(F.col("html")).alias("_page"))
        .withColumn("_cards", h.elements(F.col("_page"), tag, cls))
        # The outer form keeps the optimizer from testing (and computing) the cards twice.
        .select("page_id", "role", "page", F.posexplode_outer("_cards").alias("pos", "_card"))
    )
    read = h.read_texts(cards, "_card", CARD_FIELDS)
    tags = F.transform(h.elements(F.col("_card"), *CARD_TAG), h.without_tags)
    complete = F.col("job_title").isNotNull() & F.col("job_link").isNotNull() & F.col("posted_text").isNotNull()
    return (
        read.withColumn("job_link", h.attribute(F.col("_card"), *CARD_TITLE, "href"))
        .withColumn("_tags", tags)
        # A plain filter would be pushed below and repeat the extraction; a generated column is not.
        .withColumn("_keep", F.explode_outer(F.when(complete, F.array(F.lit(1)))))
        .filter("_keep = 1")
        .withColumn("_tags", F.array_distinct(F.transform("_tags", lambda x: F.lower(t.strip(h.decode_entities(x))))))
        .withColumn("skills_required", t.joined_skills(F.col("_tags")))
        .withColumns(_defaults(CARD_DEFAULTS))
        .withColumn("posted_date", dates.parse_posted(F.col("posted_text"), as_of))
        .withColumn("role", t.slug_from_hyphens(F.col("role")))
        .withColumn("source", F.lit(LISTING_SOURCE))
        .drop("_card", "_tags", "_keep")
    )


def card_details(pages: DataFrame) -> DataFrame:
    """``job_link, job_description, job_type, applicants`` of the cards' own pages (``url, html``)."""
    read = pages.select(F.col("url").alias("job_link"), h.visible(F.col("html")).alias("_page"))
    read = h.read_texts(read, "_page", CARD_DESCRIPTION)
    # The number is in the first span after the label.
    label = rf"(?is)<label\b[^>]*>[^<]*{APPLICANTS_LABEL}[^<]*</label\s*>"
    behind = h.after_first(F.col("_page"), label)
    return (
        read.withColumn("_count", h.after(behind, "span"))
        .drop("_page")
        .withColumn("_count", h.text_of(h.inner(F.col("_count"), "span")))
        .withColumns(_defaults({"job_description": t.NOT_AVAILABLE}))
        .withColumn("job_type", t.job_type_from_text(F.col("job_description")))
        .select("job_link", "job_description", "job_type", t.first_number(F.col("_count")).alias("applicants"))
    )


def with_card_details(cards: DataFrame, pages: DataFrame) -> DataFrame:
    """Cards joined to their own pages on the link; a missing page gives defaults."""
    details = card_details(pages)
    first = F.min(F.struct(*[c for c in details.columns if c != "job_link"])).alias("page")
    details = details.groupBy("job_link").agg(first).select("job_link", "page.*")
    defaults = {"job_description": t.NOT_AVAILABLE, "job_type": t.NOT_AVAILABLE}
    return (
        cards.join(details, "job_link", "left")
        .withColumns(_defaults(defaults))
        .withColumn("applicants", F.coalesce("applicants", F.lit(0)))
    )


def discover_links(
    pages: DataFrame,
    seen: DataFrame | None = None,
    card: tuple[str, str] | None = LINK_CARD,
    link: tuple[str, str | None] = LINK,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``url, page_id, pos``: links on listing pages, first sighting of each.

    One link per ``card`` element, or every ``link`` element when ``card`` is
    None. Empty links and those in ``seen`` (``url``) are left out. A link on very
    many pages is reduced before the shuffle (partial aggregation). ``carry`` names
    columns of the page to return as well.
    """
    page = F.col("_page")
    tag, cls = link
    if card is None:
        tags = F.regexp_extract_all(page, F.lit(h.start_tag(tag, cls)), F.lit(0))
        hrefs = F.transform(tags, lambda x: h.attribute_of(x, "href"))
    else:
        hrefs = F.transform(h.elements(page, *card), lambda c: h.attribute(c, tag, cls, "href"))
    links = (
        pages.select("page_id", *carry, h.visible(F.col("html")).alias("_page"))
        .withColumn("_links", hrefs)
        .select("page_id", *carry, F.posexplode_outer("_links").alias("pos", "url"))
        .filter("url != ''")
        .groupBy("url")
        .agg(F.min(F.struct("page_id", "pos", *carry)).alias("first"))
        .select("url", "first.page_id", "first.pos", *[f"first.{c}" for c in carry])
    )
    return links if seen is None else links.join(seen.select("url"), "url", "left_anti")
