"""English terms: words without stop words, by the stemmer of Porter 1980."""

from __future__ import annotations

import re
from functools import lru_cache

_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_longest = lambda s: sorted((tuple(x.partition(":")[::2]) for x in s.split()), key=lambda x: -len(x[0]))
STEP2, STEP3, STEP4 = _longest(_STEP2), _longest(_STEP3), _longest(_STEP4)


def _kinds(w: str) -> str:
    """c and v for each letter; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _m(w: str) -> int:
    return len(re.findall("v+c+", _kinds(w)))


def _short(w: str) -> bool:
    return _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, new in rules:
        if w.endswith(end):
            root = w[: len(w) - len(end)]
            return root + new if _m(root) > least and (end != "ion" or root[-1:] in ("s", "t")) else w
    return w


@lru_cache(100_000)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of two letters or with other signs than a to z stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        end = next((x for x in ("ed", "ing") if w.endswith(x) and "v" in _kinds(w[: -len(x)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _m(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(_swap(w, STEP2, 0), STEP3, 0), STEP4, 1)
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _m(w) > 1 else w


def english_terms(text: str | None, stop: frozenset[str]) -> list[str]:
    """Stems of the words and numbers of a text that are no stop words, in their order."""
    return [stem(re.sub("'s$", "", w)) for w in re.findall(r"[^\W_]+(?:'[^\W_]+)?", (text or "").lower().replace("’", "'")) if w not in stop]


_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def positioned_terms(text: str | None, stop: frozenset[str] | None) -> dict[str, list[int]]:
    """Each term's positions, from 1, among all words of a text. With stop words: stems of the others; without: the words themselves."""
    out: dict[str, list[int]] = {}
    low = (text or "").lower()
    if stop is None:
        for at, w in enumerate(_WORD.findall(low), 1):
            out.setdefault(w, []).append(at)
        return out
    for at, w in enumerate(re.findall(r"[^\W_]+(?:'[^\W_]+)?", low.replace("’", "'")), 1):
        if w not in stop:
            out.setdefault(stem(re.sub("'s$", "", w)), []).append(at)
    return out
