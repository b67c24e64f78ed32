"""Text functions as column expressions: tokens, stems, n-grams, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "is", "are", "be",
    "this", "that", "with", "from", "by", "as", "at", "it", "its",
)
# Suffixes in the order in which they are tried.
SUFFIXES = (
    "ational", "ation", "ations", "eness", "ingly", "edly", "ing", "ies", "ied",
    "ies", "es", "s", "ment", "ness", "ful", "less", "ize", "ise", "ity", "ive",
    "ous", "al", "er", "est", "ly", "ed",
)

#: Between the parts of identifiers: separators, lower to upper, the last upper of an acronym, digit to letter.
PART_BOUNDARY = r"[^\p{IsAlphabetic}\p{N}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=[0-9])(?=\p{IsAlphabetic})"
PREFIX = 4


def _plain(end: Column) -> Column:
    """Whether a first or last character is visible ASCII or there is none."""
    return (end == "") | end.between("!", "~")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; the pattern is only run where cutting spaces isn't enough."""
    bare = F.trim(text)
    return F.when(_plain(F.substring(bare, 1, 1)) & _plain(F.substring(bare, -1, 1)), bare).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def strip_left(text: Column) -> Column:
    """Without white space of any kind at the start."""
    bare = F.ltrim(text)
    return F.when(_plain(F.substring(bare, 1, 1)), bare).otherwise(F.regexp_replace(text, r"(?U)^\s+", ""))


def stem(word: Column) -> Column:
    """The first suffix that leaves three characters goes."""
    kept = [F.when((F.length(word) > len(s) + 2) & F.endswith(word, F.lit(s)), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in dict.fromkeys(SUFFIXES)]
    return F.coalesce(*kept, word)


def parts(text: Column) -> Column:
    """The parts of all identifiers of a text; a run of `_` and `/` alone is a part itself."""
    split = F.filter(F.split(text, PART_BOUNDARY), lambda p: p != "")
    bare = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}_/]+"), lambda p: p.rlike(r"^[_/]+$"))
    return F.concat(split, bare)


def terms(text: Column) -> Column:
    """Stemmed terms without prefixes: lower-cased parts of two bytes or more that are no stopwords."""
    low = F.transform(parts(text), F.lower)
    return F.transform(F.filter(low, is_term), stem)


def is_term(low: Column) -> Column:
    """Whether a lower-cased part is searched for: two bytes or more, no stopword."""
    return (F.octet_length(low) >= 2) & ~low.isin(*STOPWORDS)


def loose_parts(text: Column) -> Column:
    """parts, perhaps with empty ones; the second search for bare runs is only made where there is one."""
    bare = text.rlike(r"(?:^|[^\p{IsAlphabetic}\p{N}_/])[_/]{2,}(?:$|[^\p{IsAlphabetic}\p{N}_/])")
    return F.when(bare, parts(text)).otherwise(F.split(text, PART_BOUNDARY))


def tokens(text: Column) -> Column:
    """Terms, and for those of four characters or more also their first four."""
    found = terms(text)
    return F.concat(F.transform(F.filter(found, lambda t: F.length(t) >= PREFIX), lambda t: F.substring(t, 1, PREFIX)), found)


def ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the lower-cased letters and digits; a shorter text is one gram."""
    low = F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", "")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - (n - 1))), lambda i: F.substring(low, i, F.lit(n)))
    return F.when(F.length(low) == 0, F.array().cast("array<string>")).otherwise(many)


def lines(text: Column) -> Column:
    """The lines of a text; the end of the last line starts no other."""
    # split once, by a plain character
    ends = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    whole = F.when(F.endswith(ends, F.lit("\n")), F.substring(ends, F.lit(1), F.length(ends) - 1)).otherwise(ends)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n"))


def positional_similarity(a: Column, b: Column) -> Column:
    """Equal characters in equal places over the longer text's bytes."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    same = F.aggregate(pairs, F.lit(0), lambda n, x: n + x)
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(same / longest)
