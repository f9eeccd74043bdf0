"""Names, places, dates, roles, objects and events that a text is anchored to."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from versight import lexicons as L
from versight.functions import text as T

YEAR = r"\b(?:1[5-9]\d{2}|20\d{2})\b"
QUOTED = r"[\"“”‘’']([^\"“”‘’']{2,80})[\"“”‘’']"
CAPITALISED = r"\b[A-Z][a-z]+(?:[-\s][A-Z][a-z]+){0,4}\b"
EMPTY = "cast(array() as array<string>)"


def term_pattern(term: str) -> str:
    """A whole term; a blank in it matches blanks and hyphens."""
    return r"(?iU)(?<!\w)" + r"[\s-]+".join(re.escape(p) for p in term.split(" ")) + r"(?!\w)"


def _has_term(text: Column, plain: Column | None, term: str) -> Column:
    """Whether a text has a term. In its plain form (``T.plain``) a word stands between blanks: no pattern is needed for a word, and none is
    tried for other terms unless what they have in ASCII is there."""
    if plain is None:
        return text.rlike(term_pattern(term))
    words = [w for w in re.split(r"[\W_]+", term) if w]
    has = lambda w: F.contains(plain, F.lit(f" {w.lower()} " if w.isascii() else max(re.findall("[a-z0-9]*", w.lower()), key=len)))
    hits = [has(w) for w in words if "_" not in term]
    return reduce(lambda a, b: a & b, hits if [term] == words and T.whole_word(term) else [*hits, text.rlike(term_pattern(term))])


def find_terms(text: Column, terms, plain: Column | None = None) -> Column:
    return F.array_distinct(F.filter(F.array(*(F.when(_has_term(text, plain, t), t) for t in terms)), lambda x: x.isNotNull()))


def canonical(name: Column, table=L.CANONICAL) -> Column:
    clean = F.trim(F.regexp_replace(F.replace(name, F.lit("/"), F.lit(" ")), r"\s+", " "))
    out = clean
    for k, v in table.items():
        out = F.when(clean == k, v).otherwise(out)
    return out


def canonical_targets(names=L.ANCHOR_CHARACTERS) -> Column:
    """The canonical names in the order of the list, each once."""
    return F.array_distinct(F.transform(F.array(*(F.lit(n) for n in names)), lambda n: canonical(n)))


def normal(name: Column) -> Column:
    """Lower-cased, white space as single blanks, for comparisons."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def people_of(text: Column, plain: Column | None = None) -> Column:
    """The canonical names of a text."""
    return F.array_distinct(F.transform(find_terms(text, L.ANCHOR_CHARACTERS, plain), lambda n: canonical(n)))


def years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(YEAR), F.lit(0))))


def extract(text: Column, target: Column) -> Column:
    """All anchors of a text as one struct."""
    aim = canonical(F.coalesce(target, F.lit("")))
    people = people_of(text)
    groups = F.array(*(F.struct(F.lit(g).alias("g"), find_terms(text, v).alias("v")) for g, v in L.VERB_GROUPS.items()))
    phrases = F.filter(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0)), lambda p: (F.length(p) > 2) & ~F.lower(p).isin("the", "and"))
    return F.struct(
        aim.alias("target_character"),
        F.array_except(people, F.array(aim)).alias("secondary_characters"),
        find_terms(text, L.LOCATIONS).alias("locations"),
        years(text).alias("dates"),
        find_terms(text, L.INSTITUTIONS).alias("institutions"),
        find_terms(text, L.ROLES).alias("roles"),
        F.array_distinct(F.flatten(F.transform(groups, lambda x: x["v"]))).alias("event_verbs"),
        F.transform(F.filter(groups, lambda x: F.size(x["v"]) > 0), lambda x: x["g"]).alias("event_types"),
        find_terms(text, L.OBJECTS).alias("named_objects"),
        F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda q: F.trim(q)), lambda q: q != "")).alias("quoted_phrases"),
        F.array_distinct(phrases).alias("capitalized_phrases"),
    )


def strong_count(a: Column) -> Column:
    return sum((F.size(a[k]) for k in ("locations", "dates", "institutions", "roles", "named_objects")), F.size(a["secondary_characters"]))
