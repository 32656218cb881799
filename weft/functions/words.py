"""Column expressions on texts, words and lists of symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a word is letters and numbers, further runs glued by one ' or -, and one ' at the end if there is.
WORD = r"[\p{L}\p{N}]+(?:['\-][\p{L}\p{N}]+)*'?"
WORD_END, UNKNOWN = "</w>", "<ukn>"
#: A symbol stands between these two in a segmented word, so that no two symbols share a mark. No word holds either.
OPEN, CLOSE = "\x01", "\x02"


def words(text: Column) -> Column:
    """The words of a text in order; of a null text, none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def characters(word: Column) -> Column:
    """Code points; of an empty word, none."""
    return F.filter(F.split(word, ""), lambda c: c != "")


def symbols(word: Column, end: str = WORD_END) -> Column:
    return F.concat(characters(word), F.array(F.lit(end)))


def segmented(symbols_: Column) -> Column:
    """A list of symbols as one string; see OPEN and CLOSE."""
    return F.concat(F.lit(OPEN), F.array_join(symbols_, CLOSE + OPEN), F.lit(CLOSE))


def unsegmented(s: Column) -> Column:
    return F.split(F.substr(s, F.lit(2), F.length(s) - 2), CLOSE + OPEN)


def merged(s: Column, left: Column, right: Column) -> Column:
    """Every left right in a segmented word as one symbol: from the left, none used twice."""
    o, c = F.lit(OPEN), F.lit(CLOSE)
    return F.replace(s, F.concat(o, left, c, o, right, c), F.concat(o, left, right, c))


def merged_all(s: Column, rules: list[tuple[str, str]]) -> Column:
    """One sweep over the rules in their order. Equal to merging by rank for rules in the order they were learned."""
    if len(rules) <= 40:
        return reduce(lambda x, rule: merged(x, F.lit(rule[0]), F.lit(rule[1])), rules, s)
    listed = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in rules])
    return F.aggregate(listed, s, lambda x, rule: merged(x, rule["l"], rule["r"]))


def adjacent(symbols_: Column) -> Column:
    """Every two neighbours (l, r), overlaps included."""
    n = F.size(symbols_)
    left, right = F.slice(symbols_, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(symbols_, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.struct(a.alias("l"), b.alias("r")))


def known_only(symbols_: Column, alphabet: Column, unknown: str | None = UNKNOWN) -> Column:
    """Symbols outside the alphabet replaced by unknown, or dropped if that is None."""
    if unknown is None:
        return F.filter(symbols_, lambda c: F.array_contains(alphabet, c))
    return F.transform(symbols_, lambda c: F.when(F.array_contains(alphabet, c), c).otherwise(F.lit(unknown)))
