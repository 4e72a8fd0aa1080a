"""Dictionary phrases in texts.

A phrase matches where neither neighbour is a letter, digit or underscore. For a
dictionary of up to ``PATTERN_SKILLS`` phrases one regular expression, factored
like a trie, finds at every position the longest phrase that starts there; the
shorter phrases that start at the same place ("react" in "react.js") follow from
the dictionary alone. Texts are read once, in place, without a shuffle. A larger dictionary
joins on the first word of each phrase.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD
from .joins import salted_join

#: Largest dictionary that is turned into one pattern on the driver.
PATTERN_SKILLS = 2000

_BEFORE, _AFTER = rf"(?<!{WORD})", rf"(?!{WORD})"
_IS_WORD = re.compile(r"\w")


def bounded_dictionary(skills: DataFrame) -> list[str] | None:
    """Lower-cased phrases in dictionary order, or None when there are too many."""
    rows = skills.select(F.lower("skill").alias("skill"), "ord").limit(PATTERN_SKILLS + 1).collect()
    if len(rows) > PATTERN_SKILLS:
        return None
    return list(dict.fromkeys(r.skill for r in sorted(rows, key=lambda r: r.ord) if r.skill and r.skill.strip()))


def _quoted(phrase: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", phrase)


def _trie(phrases: list[str]) -> dict:
    """Characters nested in each other; the key "" marks the end of a phrase."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for letter in phrase:
            node = node.setdefault(letter, {})
        node[""] = {}
    return root


def _factored(node: dict) -> str:
    """Pattern of a trie: what phrases share is read once, and longer phrases are tried first."""
    branches = []
    for letter in sorted(node):
        if letter:
            run, below = letter, node[letter]
            while len(below) == 1 and "" not in below:  # one way on: plain text
                run, below = run + next(iter(below)), next(iter(below.values()))
            branches.append(_quoted(run) + ("" if set(below) == {""} else _factored(below)))
    inner = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
    return inner + ("?" if "" in node else "")


def _longest_phrase(phrases: list[str]) -> str:
    """Pattern whose group 1 is the longest phrase starting at a position.

    At most one branch fits the next character, so a position costs the length of
    what it shares with the dictionary, not the number of phrases.
    """
    first = "".join(sorted({_quoted(p[0]) for p in phrases}))
    return rf"{_BEFORE}(?=[{first}])(?=({_factored(_trie(phrases))}){_AFTER})"


def _implied(phrases: list[str]) -> dict[str, list[str]]:
    """Phrase -> the phrases found wherever it is found from its start on."""
    known = set(phrases)
    shorter = lambda p: [p[:i] for i in range(1, len(p)) if p[:i] in known and not _IS_WORD.match(p[i])]
    return {p: [p, *shorter(p)] for p in phrases}


def skills_in(text: Column, phrases: list[str]) -> Column:
    """Sorted distinct dictionary phrases in ``text``; empty for a NULL text."""
    if not phrases:
        return F.array().cast("array<string>")
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_longest_phrase(phrases)), F.lit(1)))
    shorter = {p: q for p, q in _implied(phrases).items() if len(q) > 1}
    if shorter:
        # one literal, read once: a map made entry by entry takes longer to build than to use
        implied = F.from_json(F.lit(json.dumps(shorter)), "map<string,array<string>>")
        found = F.flatten(F.transform(found, lambda p: F.coalesce(F.try_element_at(implied, p), F.array(p))))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def bounded_pattern(phrase: Column) -> Column:
    """Whole-word pattern of a phrase column."""
    quoted = F.regexp_replace(phrase, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.concat(F.lit(_BEFORE), quoted, F.lit(_AFTER))


def occurrences(text: Column, phrase: Column) -> Column:
    """How often a phrase occurs as a whole word, ignoring case."""
    return F.regexp_count(F.lower(text), bounded_pattern(phrase))


def skill_counts(text: Column, skills: Column) -> Column:
    """Array of ``(skill, n)`` for skills known to be in ``text``."""
    return F.transform(skills, lambda s: F.struct(s.alias("skill"), occurrences(text, s).alias("n")))


def by_frequency(counts: Column) -> Column:
    """Skills of an array of ``(skill, n)``: most frequent first, then by name."""
    keyed = F.transform(counts, lambda c: F.struct((-c["n"]).alias("n"), c["skill"].alias("skill")))
    return F.transform(F.array_sort(keyed), lambda c: c["skill"])


def extract_skills(
    df: DataFrame, skills: DataFrame, text: str = "text", key: str = "id", out: str = "skills"
) -> DataFrame:
    """Adds ``out``: the sorted dictionary phrases in ``text``."""
    phrases = bounded_dictionary(skills)
    if phrases is not None:
        return df.withColumn(out, skills_in(F.col(text), phrases))
    return extract_skills_by_join(df, skills, text, key, out)


def extract_skills_by_join(df: DataFrame, skills: DataFrame, text: str, key: str, out: str) -> DataFrame:
    """``extract_skills`` for a dictionary of any size.

    Distinct words of a text meet the phrases with that first word; only hashes of texts
    and words travel. The texts then check their few phrases in place. Texts are known
    by their digest, so rows with a NULL or repeated ``key`` are read like all others.
    Phrases without a word character meet on their first sign instead.
    """
    lowered, first = F.lower(text), rf"{WORD}+|[^\s]"
    known = skills.select(F.lower("skill").alias("skill")).filter(F.trim("skill") != "").distinct()
    word = F.regexp_extract("skill", f"{WORD}+", 0)
    known = known.select("skill", F.when(word != "", word).otherwise(F.left(F.trim("skill"), F.lit(1))).alias("word"))
    texts = df.withColumn("_text", F.sha2(lowered, 256))
    words = texts.select(
        "_text", F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(first), F.lit(0)))).alias("word")
    )
    possible = (
        salted_join(words, known, ["word"], F.col("_text")).groupBy("_text").agg(F.collect_set("skill").alias("_possible"))
    )
    sure = F.filter("_possible", lambda s: F.regexp_like(lowered, bounded_pattern(s)))
    found = F.coalesce(F.array_sort(sure), F.array().cast("array<string>"))
    return texts.join(possible, "_text", "left").withColumn(out, found).drop("_possible", "_text")


def overlap(mine: Column, wanted: Column) -> Column:
    """Skills on both sides, sorted."""
    return F.array_sort(F.array_intersect(mine, wanted))


def matched_skills(counts: Column, mine: Column) -> Column:
    """Skills of ``counts`` that are in ``mine``, most frequent first."""
    return by_frequency(F.filter(counts, lambda c: F.array_contains(mine, c["skill"])))


def with_default_skills(skills: Column, defaults: list[str], least: int = 3) -> Column:
    """Adds the default skills when fewer than ``least`` were found."""
    return F.when(F.size(skills) < least, F.array_union(skills, F.array(*map(F.lit, defaults)))).otherwise(skills)
