"""English stems by the published suffix-stripping algorithm (Porter, 1980), and lexemes of a text."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The algorithm's suffix tables, in its order, and a short list of stop words.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
STOP = frozenset("a an and are as at be but by for from has have in is it its of on or that the this to was were will with".split())

_TABLES = [sorted((tuple(x.split(":")) for x in t.split()), key=lambda x: -len(x[0])) for t in (STEP2, STEP3)]
_LAST = sorted(STEP4.split(), key=len, reverse=True)
_WORD = re.compile(r"[^\W_]+")


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and those that are not a-z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            base = word.removesuffix(end)
            if base != word:
                if "v" in _shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        word = base + "e"
                    elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                        word = base[:-1]
                    else:
                        word = base + "e" if _measure(base) == 1 and _short_end(base) else base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in _TABLES:
        for end, new in table:
            if word.endswith(end):
                base = word[: len(word) - len(end)]
                word = base + new if _measure(base) else word
                break
    for end in _LAST:
        if word.endswith(end):
            base = word[: len(word) - len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e"):
        base, m = word[:-1], _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(base):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def lexemes(text: str | None) -> list[str]:
    """The distinct stems of a text's words but stop words, in bytewise order."""
    words = _WORD.findall((text or "").lower())
    return sorted({stem(w) for w in words if w not in STOP}, key=str.encode)


def positions(text: str | None, asked: frozenset[str] | set[str] | None = None) -> dict[str, list[int]]:
    """The places, from 1, of each stem among all words of a text; stop words take a place and have none. ``asked`` narrows the stems."""
    out: dict[str, list[int]] = {}
    for place, word in enumerate(_WORD.findall((text or "").lower()), 1):
        if word not in STOP:
            lexeme = stem(word)
            if asked is None or lexeme in asked:
                out.setdefault(lexeme, []).append(place)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def lexeme_list(texts: pd.Series) -> pd.Series:
    return texts.map(lexemes)
