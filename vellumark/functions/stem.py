"""English lexemes: lower-cased words, without stop words, stemmed by Porter's published algorithm (1980)."""

from __future__ import annotations

import functools
import re
from collections import Counter

# Common English stop words.
STOP = frozenset("a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split())
_WORD = re.compile(r"[^\W_]+")
# Porter's suffix tables of steps 2 to 4.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@functools.lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if len(w) > 2 and w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, by in sorted(table, key=lambda t: -len(t[0])):
            if w.endswith(end):
                w = w[: -len(end)] + by if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(_STEP4, key=lambda t: -len(t)):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def lexemes(text: str | None) -> list[str]:
    return [stem(w) for w in _WORD.findall((text or "").lower()) if w not in STOP]


def counts(text: str | None) -> tuple[dict[str, int], int]:
    """How often each lexeme occurs, and all occurrences; each distinct word is stemmed once."""
    out: dict[str, int] = {}
    total = 0
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        if w not in STOP:
            s = stem(w)
            out[s] = out.get(s, 0) + n
            total += n
    return out, total


def counts_of(text: str | None, wanted: list[str]) -> tuple[dict[str, int], int]:
    """The same for some lexemes only. Stemming keeps a word's first two letters, so only words that begin alike are stemmed."""
    heads = tuple({w[:2] for w in wanted})
    out: dict[str, int] = {}
    words = [w for w in _WORD.findall((text or "").lower()) if w not in STOP]
    for w in words:
        if w.startswith(heads) and (s := stem(w)) in wanted:
            out[s] = out.get(s, 0) + 1
    return out, len(words)
