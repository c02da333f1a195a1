"""The suffix-stripping stemmer as published by M. F. Porter (Program 14(3), 1980)."""

from __future__ import annotations

import re

# --- fixed values: the published suffix lists -------------------------------------------------
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# ------------------------------------------------------------------------------------------------


def _shape(word: str) -> str:
    """The word as consonants (c) and vowels (v)."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for s in sorted(table, key=len, reverse=True):
            if w.endswith(s):
                if measure(w[: -len(s)]) > 0:
                    w = w[: -len(s)] + table[s]
                break
    for s in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            if measure(base) > 1 and (s != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _double(w) and w[-1] == "l" and measure(w) > 1:
        w = w[:-1]
    return w
