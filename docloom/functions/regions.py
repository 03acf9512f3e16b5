"""A stemmer that looks at the part of a word an ending leaves, in ordered steps.

The published algorithm for English suffixes (1980): what may be taken off
depends on the measure of the rest, the number of times that vowels are followed
by consonants in it. It runs once for each distinct word, not for each token.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The endings of steps 2, 3 and 4, with what stands in their place.
STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
STEP3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", shape(word)))


def ends_short(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last no w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def replaced(word: str, table: list[str], least: int) -> str:
    """The longest ending that fits is replaced if the rest's measure allows."""
    pairs = sorted(zip(table[::2], table[1::2], strict=True), key=lambda x: -len(x[0]))
    for end, new in pairs:
        if word.endswith(end):
            rest = word[: -len(end)]
            return rest + new.strip("-") if measure(rest) >= least else word
    return word


def plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        rest = word[: -len(end)]
        if word.endswith(end) and "v" in shape(rest):
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if doubled(rest) and rest[-1] not in "lsz":
                return rest[:-1]
            return rest + "e" if measure(rest) == 1 and ends_short(rest) else rest
    return word


def last_ending(word: str) -> str:
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if end in ("sion", "tion"):
                rest += end[0]
            return rest if measure(rest) > 1 else word
    return word


def last_e(word: str) -> str:
    rest = word[:-1]
    if word.endswith("e") and (measure(rest) > 1 or measure(rest) == 1 and not ends_short(rest)):
        word = rest
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stem(word: str) -> str:
    """Words of up to two letters, and what is no lower-case ASCII, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    word = past(plural(word))
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    return last_e(last_ending(replaced(replaced(word, STEP2, 1), STEP3, 1)))


def stems(words: DataFrame) -> DataFrame:
    """(term, stem) of distinct terms."""

    @F.pandas_udf("string")
    def each(terms: pd.Series) -> pd.Series:
        return terms.map(stem)

    return words.select("term").distinct().withColumn("stem", each("term"))
