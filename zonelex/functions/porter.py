"""The Porter stemmer (1980 rules, as in Snowball's "porter": no minimum length) and its vectorised column form."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of the second, third and fourth step with what replaces them.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "eli": "e", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alli": "al", "aliti": "al", "alism": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ative": "", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT = re.compile(r"[^aeiouy][aeiouy][^aeiouywxY]$")
_Y_AFTER_VOWEL = re.compile(r"([aeiouy])y")



def _finder(suffixes):
    """The longest listed suffix of a word, or ''."""
    lengths = sorted({len(s) for s in suffixes}, reverse=True)
    known = frozenset(suffixes)

    def find(word: str) -> str:
        for n in lengths:
            if len(word) >= n and word[-n:] in known:
                return word[-n:]
        return ""

    return find


_find_2, _find_3, _find_4 = _finder(STEP_2), _finder(STEP_3), _finder(STEP_4)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if not word:
        return word
    w = ("Y" + word[1:]) if word[0] == "y" else word
    if "y" in w:
        w = _Y_AFTER_VOWEL.sub(r"\1Y", w)
    m = _REGION.match(w)
    p1 = m.end() if m else len(w)
    m = _REGION.match(w, p1) if m else None
    p2 = m.end() if m else len(w)

    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # -eed, -ed, -ing
    if w.endswith("eed"):
        if len(w) - 3 >= p1:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _VOWEL.search(w, 0, len(w) - cut):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                w = w[:-1]
            elif len(w) == p1 and _SHORT.search(w):
                w += "e"
    # final y
    if w[-1:] in ("y", "Y") and _VOWEL.search(w, 0, len(w) - 1):
        w = w[:-1] + "i"
    # long suffixes
    s = _find_2(w)
    if s and len(w) - len(s) >= p1:
        w = w[: -len(s)] + STEP_2[s]
    s = _find_3(w)
    if s and len(w) - len(s) >= p1:
        w = w[: -len(s)] + STEP_3[s]
    s = _find_4(w)
    if s and len(w) - len(s) >= p2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    # final e and ll
    if w.endswith("e"):
        at = len(w) - 1
        if at >= p2 or (at >= p1 and not _SHORT.search(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and len(w) - 1 >= p2:
        w = w[:-1]
    return w.replace("Y", "y")


class Stems(dict):
    """Memory of stems; tokens with a digit stay as they are. Emptied when it grows beyond its bound."""

    BOUND = 500_000

    def __missing__(self, token: str) -> str:
        if len(self) > self.BOUND:
            self.clear()
        self[token] = out = token if any(c.isdigit() for c in token) else stem(token)
        return out


_STEMS = Stems()


@F.pandas_udf(T.StringType())
def _stem_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else _STEMS[t])


def stem_column(token: Column) -> Column:
    """Stem of a token column, by Arrow batches with a memory of stems. Nulls stay null."""
    return _stem_udf(token)
