"""Similarity score of a name and a needle, as one column expression without Python."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of ECMAScript, as a character class.
BLANK = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _bigrams(s: Column) -> Column:
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the multisets of character bigrams; white space doesn't count, case does.

    Equal strings (also both empty) give 1, else one of fewer than two characters gives 0.
    """
    a, b = F.regexp_replace(a, BLANK, ""), F.regexp_replace(b, BLANK, "")
    of_a, of_b = _bigrams(a), _bigrams(b)
    many = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    shared = F.aggregate(F.array_distinct(of_a), F.lit(0), lambda acc, g: acc + F.least(many(of_a, g), many(of_b, g)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(F.lit(2.0) * shared / (F.length(a) + F.length(b) - 2))


def dice_to(a: Column, needle: str) -> Column:
    """dice() with a fixed string, whose bigrams are counted here; no arrays are built per row."""
    b = re.sub(BLANK, "", needle)
    a = F.regexp_replace(a, BLANK, "")
    shared = F.lit(0)
    for gram, n in Counter(b[i : i + 2] for i in range(len(b) - 1)).items():
        if gram[0] == gram[1]:  # may overlap itself
            found = F.regexp_count(a, F.lit(f"{re.escape(gram[0])}(?={re.escape(gram[1])})"))
        else:
            found = ((F.length(a) - F.length(F.replace(a, F.lit(gram), F.lit("")))) / 2).cast("int")
        shared = shared + F.least(found, F.lit(n))
    same = F.when(a == F.lit(b), 1.0)
    return same.otherwise(0.0) if len(b) < 2 else same.when(F.length(a) < 2, 0.0).otherwise(F.lit(2.0) * shared / (F.length(a) + len(b) - 2))


def score(name: Column, needle: Column | str) -> Column:
    """1 if equal, 0.9 if equal without case, 0.8 if the name contains the needle without case, else dice(). Null for nulls."""
    rest = dice_to(name, needle) if isinstance(needle, str) else dice(name, needle)
    needle = F.lit(needle) if isinstance(needle, str) else needle
    low, sought = F.lower(name), F.lower(needle)
    out = F.when(name == needle, 1.0).when(low == sought, 0.9).when(F.contains(low, sought), 0.8).otherwise(rest)
    return F.when(name.isNotNull() & needle.isNotNull(), out)
