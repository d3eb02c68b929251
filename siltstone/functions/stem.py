"""English stems by the published Porter2 rules, for distinct words in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: endings, exceptions and stop words of the published English rules
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)

VOWEL = "aeiouy"
_REGION = re.compile(f"[{VOWEL}][^{VOWEL}]")
_SHORT = re.compile(f"(?:[^{VOWEL}][{VOWEL}][^{VOWEL}wxY]|^[{VOWEL}][^{VOWEL}])$")


def _region(word: str, start: int = 0) -> int:
    """Where the part behind the first consonant after a vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _verb(word: str, r1: int) -> str:
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if not end:
        return word
    left = word[: -len(end)]
    if end.startswith("eed"):
        return left + "ee" if len(left) >= r1 else word
    if not re.search(f"[{VOWEL}]", left):
        return word
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if left.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return left[:-1]
    return left + "e" if len(left) <= r1 and _SHORT.search(left) else left


@lru_cache(1 << 16)
def english(word: str) -> str:
    """The stem of a lower-case word of letters; other words are their own stems."""
    if len(word) < 3 or not word.isalpha():
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(f"^y|(?<=[{VOWEL}])y", "Y", word)
    special = re.match("gener|commun|arsen", w)
    r1 = special.end() if special else _region(w)
    r2 = _region(w, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in AFTER_PLURAL:
        return w
    w = _verb(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    end = _ending(w, STEP2)
    left = w[: len(w) - len(end)]
    if end and len(left) >= r1 and (end != "ogi" or left.endswith("l")) and (end != "li" or left[-1:] in tuple("cdeghkmnrt")):
        w = left + STEP2[end]
    end = _ending(w, STEP3)
    left = w[: len(w) - len(end)]
    if end and len(left) >= (r2 if end == "ative" else r1):
        w = left + STEP3[end]
    end = _ending(w, STEP4)
    left = w[: len(w) - len(end)]
    if end and len(left) >= r2 and (end != "ion" or left.endswith(("s", "t"))):
        w = left
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    """Stems of lower-case words."""
    return words.map(lambda w: None if w is None else english(w))
