"""English (Porter2) stemmer, written from the published description of the algorithm. One call a distinct word."""

from __future__ import annotations

import re

_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
# Fixed values of the published algorithm: exceptions, and endings with their replacements.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _after_first(word: str, start: int) -> int:
    """The place after the first non-vowel that follows a vowel, from start on."""
    found = re.compile(f"[{_VOWEL}][^{_VOWEL}]").search(word, start)
    return found.end() if found else len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWEL and word[1] not in _VOWEL
    return len(word) > 2 and word[-3] not in _VOWEL and word[-2] in _VOWEL and word[-1] not in _VOWEL + "wxY"


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    word = word.lower().replace("’", "'")
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    word = re.sub(f"(^|(?<=[{_VOWEL}]))y", "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), "")
    r1 = len(prefix) if prefix else _after_first(word, 0)
    r2 = _after_first(word, r1)

    word = word.removesuffix(_longest(word, ("'", "'s", "'s'"))) if "'" in word else word
    ending = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and any(c in _VOWEL for c in word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word

    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and any(c in _VOWEL for c in word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"

    ending = _longest(word, (*_STEP2, "ogi", "li"))
    if ending and len(word) - len(ending) >= r1:
        if ending in _STEP2:
            word = word[: -len(ending)] + _STEP2[ending]
        elif ending == "ogi" and word[-4:-3] == "l":
            word = word[:-1]
        elif ending == "li" and word[-3:-2] and word[-3] in _LI:
            word = word[:-2]
    ending = _longest(word, (*_STEP3, "ative"))
    if ending and len(word) - len(ending) >= r1:
        if ending == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(ending)] + _STEP3[ending]
    ending = _longest(word, (*_STEP4, "ion"))
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
