"""Element lookup in HTML text as column expressions.

Pages are read in three steps: ``visible`` drops scripts, styles and comments,
``after`` and ``inner`` find the inner HTML of an element with a tag and class, and
``text_of`` turns inner HTML into plain text. ``read_texts`` does it for many fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Named character references; ``&amp;`` goes last so nothing is decoded twice.
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&nbsp;": "\u00a0",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&bull;": "•",
    "&middot;": "·",
    "&hellip;": "…",
    "&copy;": "©",
    "&reg;": "®",
    "&trade;": "™",
    "&pound;": "£",
    "&euro;": "€",
    "&amp;": "&",
}


#: Marks cut places; a control character that ``visible`` removes from pages.
_CUT = "\x01"


def visible(html: Column) -> Column:
    """HTML without comments, scripts, styles and templates."""
    # One class of first characters, so that most places of a page are passed by one comparison.
    return F.regexp_replace(html, r"[<\x01](?:(?<=\x01)|!--(?s:.*?)-->|(?is:(script|style|template)\b.*?</\1\s*>))", "")


def _pieces(html: Column, pattern: str) -> Column:
    """Split at a pattern. ``split`` would compile the pattern once per row."""
    return F.split(F.regexp_replace(html, pattern, _CUT), _CUT)


def after_first(html: Column, pattern: str) -> Column:
    """What follows the first match; NULL without one."""
    place = F.regexp_instr(html, F.lit(pattern))
    return F.when(place > 0, F.substr(html, place + F.length(F.regexp_extract(html, pattern, 0))))


def _before_first(html: Column, pattern: str) -> Column:
    """What precedes the first match; everything without one."""
    place = F.regexp_instr(html, F.lit(pattern))
    return F.when(place > 0, F.substr(html, F.lit(1), place - 1)).otherwise(html)


def start_tag(tag: str, cls: str | None = None) -> str:
    """Pattern of a start tag that carries the class ``cls`` (exact case) among its classes."""
    if cls is None:
        return rf"<(?i:{tag}\b)[^>]*>"
    name = cls.replace("-", r"\-")
    quoted = rf"""["'](?:[^"'>]*\s)?{name}(?:\s[^"'>]*)?["']"""
    return rf"""<(?i:{tag}\b)[^>]*?(?i:\sclass)\s*=\s*(?:{quoted}|{name}(?=[\s>]))[^>]*>"""


def _end_tag(tag: str) -> str:
    return rf"</(?i:{tag})\s*>"


def up_to_end(rest: Column, tag: str) -> Column:
    """What follows a start tag up to the next end tag of that kind; ``rest`` is a stored column."""
    # The usual spelling is found by a plain search; the pattern serves the others.
    plain = F.substring_index(rest, f"</{tag}>", 1)
    return F.when(~F.regexp_like(plain, F.lit(_end_tag(tag))), plain).otherwise(_before_first(rest, _end_tag(tag)))


def inner(rest: Column, tag: str, first: Column | None = None) -> Column:
    """What follows a start tag up to its own end tag, nested elements included.

    ``rest`` is split at the end tags; the element ends at the first piece by
    which as many end tags as start tags were seen. An unclosed element runs to
    the end, as in a browser. ``first`` is ``up_to_end`` where it is known.
    """
    first = up_to_end(rest, tag) if first is None else first
    opened = lambda piece: F.regexp_count(piece, F.lit(rf"<(?i:{tag}\b)"))
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("html"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + opened(piece) - 1
        done = acc["depth"] == 0
        html = F.concat(acc["html"], piece, F.when(depth > 0, F.lit(f"</{tag}>")).otherwise(""))
        return F.struct(
            F.when(done, acc["depth"]).otherwise(depth).alias("depth"),
            F.when(done, acc["html"]).otherwise(html).alias("html"),
        )

    nested = F.aggregate(_pieces(rest, _end_tag(tag)), start, step, lambda acc: acc["html"])
    return F.when(opened(first) == 0, first).otherwise(nested)


def after(html: Column, tag: str, cls: str | None = None) -> Column:
    """What follows the first such start tag; NULL when there is none."""
    found = after_first(html, start_tag(tag, cls))
    # A plain search for the class name spares most pages the pattern.
    return found if cls is None else F.when(html.contains(cls), found)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def elements(html: Column, tag: str, cls: str) -> Column:
    """Inner HTML of every such element, in page order."""
    pieces = _pieces(html, start_tag(tag, cls))
    later = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    return F.when(html.contains(cls), F.transform(later, lambda piece: inner(piece, tag))).otherwise(none)


def attribute(html: Column, tag: str, cls: str | None, name: str) -> Column:
    """Attribute of the first such start tag; NULL when tag or attribute is missing."""
    found = F.regexp_substr(html, F.lit(start_tag(tag, cls)))
    return attribute_of(found, name)


def attribute_of(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']"""
    return F.when(F.regexp_like(tag, F.lit(pattern)), decode_entities(F.regexp_extract(tag, pattern, 1)))


def _code_point(reference: Column) -> Column:
    """The character of ``&#8364;`` or ``&#x20AC;``; U+FFFD for numbers that are no character."""
    hexadecimal = F.regexp_extract(reference, r"(?i)^&#x0*([0-9a-f]{0,6});$", 1)
    decimal = F.regexp_extract(reference, r"^&#0*([0-9]{0,7});$", 1)
    value = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(decimal).try_cast("bigint")
    sound = value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(sound, value).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Numeric and common named character references -> characters."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&#(?:[0-9]+|[xX][0-9a-fA-F]+);|[^&]+|&"), F.lit(0))
    is_number = lambda p: F.regexp_like(p, F.lit(r"^&#(?:[0-9]+|[xX][0-9a-fA-F]+);$"))
    numbers = F.array_join(F.transform(pieces, lambda p: F.when(is_number(p), _code_point(p)).otherwise(p)), "")
    named = F.when(text.contains("&#"), numbers).otherwise(text)
    for reference, character in ENTITIES.items():
        named = F.replace(named, F.lit(reference), F.lit(character))
    return F.when(text.contains("&"), named).otherwise(text)


def without_tags(html: Column) -> Column:
    return F.when(html.contains("<"), F.regexp_replace(html, r"(?s)<[^>]*>", "")).otherwise(html)


def text_of(html: Column) -> Column:
    """Plain text of inner HTML: tags dropped, references decoded, ends trimmed."""
    return strip(decode_entities(without_tags(html)))


def read_texts(df: DataFrame, html: str, fields: dict[str, list[tuple[str, str | None]]]) -> DataFrame:
    """Adds one text column per field: the first selector that is present, else NULL.

    The work is laid out in steps, each a column of its own, so that no step is
    evaluated more than once per row.
    """
    page = F.col(html)
    heads, tails, attributes, rests, firsts, inners = {}, {}, {}, {}, {}, {}
    for name, selectors in fields.items():
        tags = [t for t, _ in selectors]
        runs = [[s for s in selectors if s[0] == t] for t in dict.fromkeys(tags)]
        if [s for run in runs for s in run] != selectors:
            raise ValueError(f"selectors of {name} must be grouped by tag")
        found = []
        for run in runs:
            tag = run[0][0]
            rest, first = f"_{name}_{tag}", f"_{name}_{tag}_first"
            options = []
            for i, (_, cls) in enumerate(run):
                if cls is None:
                    options.append(after(page, tag))
                    continue
                # The first place of the class name, by a plain search. When it lies in a
                # start tag that fits, that is the first one; else the pattern decides.
                head, tail, attribute_ = (f"{rest}_{part}{i}" for part in ("head", "tail", "attributes"))
                heads[head] = F.when(page.contains(cls), F.substring_index(page, cls, 1))
                tails[tail] = F.substr(page, F.length(head) + (len(cls) + 1))
                attributes[attribute_] = F.substring_index(tail, ">", 1)
                start = F.concat(
                    F.lit("<"), F.substring_index(head, "<", -1), F.lit(cls), F.col(attribute_), F.lit(">")
                )
                pattern = start_tag(tag, cls)
                fits = F.col(tail).contains(">") & F.regexp_like(start, F.lit(f"^(?:{pattern})$"))
                plain = F.substr(tail, F.length(attribute_) + 2)
                options.append(F.when(F.col(head).isNotNull(), F.when(fits, plain).otherwise(after_first(page, pattern))))
            rests[rest] = F.coalesce(*options)
            firsts[first] = up_to_end(F.col(rest), tag)
            found.append(inner(F.col(rest), tag, F.col(first)))
        inners[name] = F.coalesce(*found)
    places = [*heads, *tails, *attributes]
    return (
        df.withColumns(heads)
        .withColumns(tails)
        .withColumns(attributes)
        .withColumns(rests)
        .drop(*places)
        .withColumns(firsts)
        .withColumns(inners)
        .drop(*rests, *firsts)
        .withColumns({n: without_tags(F.col(n)) for n in fields})
        .withColumns({n: decode_entities(F.col(n)) for n in fields})
        .withColumns({n: strip(F.col(n)) for n in fields})
    )
