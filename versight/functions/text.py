"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_array(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.expr("cast(array() as array<string>)")


def tokenise(text: Column) -> Column:
    """Runs of ASCII letters, digits and apostrophes of three characters or more, lower-cased."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1)), lambda t: F.length(t) >= 3)


def words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(clean == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(clean, " "))


#: Characters that patterns without regard to case take for a letter of a-z, though lower-casing doesn't make them one.
FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def phrase_pattern(phrase: str) -> str:
    """A whole phrase, without regard to case, between characters that are not part of a word.

    The phrase comes before the look-behind, which so runs at the places that have it and at no others.
    """
    return rf"(?iU)\Q{phrase}\E(?<!\w\Q{phrase}\E)(?!\w)"


def plain(text: Column) -> Column:
    """The text for ``whole_word``: lower-cased, each run of characters that are not part of a word as two blanks, blanks around it."""
    for c, to in FOLDED.items():
        text = F.replace(text, F.lit(c), F.lit(to))
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"(?U)[ ,.[^a-z0-9_\w]]+", "  "), F.lit(" "))


def whole_word(phrase: str) -> bool:
    """Whether a phrase is one word in ASCII, which a plain text has between blanks, so that no pattern is needed."""
    return phrase.isascii() and phrase.replace("_", "a").isalnum()


def phrase_count(text: Column, phrase: str, plain_text: Column | None = None) -> Column:
    """Occurrences of a whole phrase; a word's are counted in ``plain_text`` (see ``plain``) where that is given."""
    if plain_text is None or not whole_word(phrase):
        return F.regexp_count(text, F.lit(phrase_pattern(phrase)))
    less = F.octet_length(F.replace(plain_text, F.lit(f" {phrase.lower()} "), F.lit("")))
    return ((F.octet_length(plain_text) - less) / (len(phrase) + 2)).cast("int")


def any_phrase(text: Column, phrases, plain_text: Column | None = None) -> Column:
    """Whether a whole phrase occurs."""
    words = [p for p in phrases if plain_text is not None and whole_word(p)]
    others = [p for p in phrases if p not in words]
    hits = [F.contains(plain_text, F.lit(f" {w.lower()} ")) for w in words]
    if others or not words:
        hits.append(text.rlike("(?iU)(?:" + "|".join(rf"\Q{p}\E(?<!\w\Q{p}\E)(?!\w)" for p in others) + ")"))
    return reduce(lambda a, b: a | b, hits)


def slug(text: Column, default: str = "book") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", default).otherwise(made)


def book_key(name: Column) -> Column:
    """Quotes, folders and the file ending off, white space collapsed, lower-cased."""
    base = F.regexp_extract(F.trim(F.trim(name), F.lit('"')), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.lower(F.trim(F.regexp_replace(stem, r"\s+", " ")))


def preview(text: Column, limit: int) -> Column:
    """White space collapsed; beyond the limit cut at the last blank, with an ellipsis."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(F.regexp_replace(F.left(clean, F.lit(limit)), " [^ ]*$", "")), F.lit(" ...")))


def window_around(text: Column, token: Column, margin: int = 60) -> Column:
    """The characters around the first occurrence of a token (from the start if there is none)."""
    at = F.greatest(F.instr(F.lower(text), F.lower(token)) - 1, F.lit(0))
    start = F.greatest(at - margin, F.lit(0))
    return F.trim(F.substring(text, start + 1, at + F.length(token) + margin - start))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length, 0 for a zero vector."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, F.lit(1), n), lambda e: e.cast("double")) for v in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    norm = F.sqrt(total(F.transform(x, lambda e: e * e))) * F.sqrt(total(F.transform(y, lambda e: e * e)))
    return F.when((n <= 0) | (norm == 0), 0.0).otherwise(total(F.zip_with(x, y, lambda p, q: p * q)) / norm)


def hashed_embedding(text: Column, synonyms: dict[str, str], dims: int = 32) -> Column:
    """Unit vector of token counts by bucket; the bucket is taken from the token's md5."""
    table = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair)) if synonyms else F.expr("cast(map() as map<string,string>)")
    bucket = lambda t: F.conv(F.left(F.md5(F.coalesce(F.element_at(table, t), t)), F.lit(8)), 16, 10).cast("long") % dims

    def unit(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c))
        return let(norm, lambda n: F.when(n == 0, counts).otherwise(F.transform(counts, lambda c: c / n)))

    def counted(at: Column) -> Column:
        # a letter for each token's bucket; what taking a letter out shortens is its count
        less = lambda d: F.octet_length(at) - F.octet_length(F.replace(at, F.lit(chr(48 + d)), F.lit("")))
        return let(F.array(*(less(d).cast("double") for d in range(dims))), unit)

    if dims > 79:
        raise ValueError("at most 79 buckets")
    return let(F.array_join(F.transform(tokenise(text), lambda t: F.char(bucket(t) + 48)), ""), counted)


def keywords(text: Column, stop, limit: int = 10) -> Column:
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9'-]+)"), F.lit(1)), lambda t: (F.length(t) > 2) & ~t.isin(*stop))
    return F.slice(F.array_distinct(found), 1, limit)
