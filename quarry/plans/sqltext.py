"""SQL forms (DuckDB) of the text functions, for the oracles."""

from __future__ import annotations

from quarry.functions.text import PREFIX, STOPWORDS, SUFFIXES


def stem(word: str) -> str:
    cases = " ".join(f"WHEN length({word}) > {len(s) + 2} AND ends_with({word}, '{s}') THEN left({word}, length({word}) - {len(s)})" for s in dict.fromkeys(SUFFIXES))
    return f"CASE {cases} ELSE {word} END"


def words(rows: str, key: str, text: str) -> str:
    """A query of (key, term), one row for each stemmed term of `text` in `rows`."""
    split = text
    for a, b in ((r"(\p{Ll})(\p{Lu})", r"\1 \2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2"), (r"([0-9])(\p{L})", r"\1 \2")):
        split = f"regexp_replace({split}, '{a}', '{b}', 'g')"
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    parts = rf"list_concat(regexp_split_to_array({split}, '[^\p{{L}}\p{{N}}]+'), list_filter(regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}_/]+'), lambda p: regexp_matches(p, '^[_/]+$')))"
    return f"SELECT {key}, {stem('w')} AS term FROM (SELECT {key}, lower(unnest({parts})) AS w FROM {rows}) WHERE w <> '' AND strlen(w) >= 2 AND w NOT IN ({stop})"


def tokens(rows: str, key: str, text: str) -> str:
    inner = words(rows, key, text)
    return f"SELECT {key}, unnest(CASE WHEN length(term) >= {PREFIX} THEN [left(term, {PREFIX}), term] ELSE [term] END) AS term FROM ({inner})"
