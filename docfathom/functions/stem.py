"""Porter's stemmer (1980) as an Arrow-batched column, and preprocessing strategies of tokens."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import tokens

# The algorithm's endings, with what replaces them, in the order they are tried.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for a consonant, v for a vowel; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(part: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(part).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last one not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, endings, least: int) -> str:
    """The longest ending that fits goes, if what is left measures over `least`."""
    fit = max((e for e in endings if word.endswith(e[0])), key=lambda e: len(e[0]), default=None)
    if fit and _measure(word[: len(word) - len(fit[0])]) > least:
        return word[: len(word) - len(fit[0])] + fit[1]
    return word


@functools.lru_cache(100_000)
def porter(word: str) -> str:
    """The stem of a word in lower case; words of two letters or other characters than a to z stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, STEP_2, 0)
    word = _replaced(word, STEP_3, 0)
    fit = max((e for e in STEP_4 if word.endswith(e)), key=len, default=None)
    if fit and _measure(word[: -len(fit)]) > 1 and (fit != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(fit)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if _measure(word) > 1 and _doubled(word) and word.endswith("l"):
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """The stem of each word."""
    return words.map(lambda w: None if w is None else porter(w))


@F.pandas_udf(ArrayType(StringType()))
def stemmed_all(words: pd.Series) -> pd.Series:
    """The stems of each array of words."""
    return words.map(lambda ws: None if ws is None else [porter(w) for w in ws])


def preprocessed(text: Column, strategy: str = "lowercase", twice: bool = False) -> Column:
    """Tokens as a strategy has them: none or lowercase leave them, porter stems them. twice: stems are stemmed again and dropped where
    they have become stop words or too short, as a second pass of the whole preprocessing does."""
    toks = tokens(text)
    if strategy in ("none", "lowercase"):
        return toks
    if strategy != "porter":
        raise ValueError(f"no such strategy: {strategy}")
    stems = stemmed_all(toks)
    return stemmed_all(tokens(F.array_join(stems, " "))) if twice else stems
