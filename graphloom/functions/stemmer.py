"""The English (Porter2) stemmer, after M. F. Porter's published description."""

from __future__ import annotations

import re
from functools import lru_cache

VOWEL = "aeiouy"
# Whole words with a stem of their own, and words that later steps must leave alone.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes of the steps 2 to 4 with what replaces them.
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("fulli", "ful"),
    ("ousli", "ous"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"),
    ("ness", ""), ("ful", ""),
)
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_BEFORE = "cdeghkmnrt"


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, once and twice."""
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        m = re.search(rf"[{VOWEL}][^{VOWEL}]", w)
        r1 = m.end() if m else len(w)
    m = re.search(rf"[{VOWEL}][^{VOWEL}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"(?:^[{VOWEL}][^{VOWEL}]|[^{VOWEL}][{VOWEL}][^{VOWEL}wxY])$", w))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").lstrip("'")
    if w in SPECIAL:
        return SPECIAL[w]
    # A y that acts as a consonant is written Y.
    w = re.sub(r"^y", "Y", w)
    w = re.sub(rf"(?<=[{VOWEL}])y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(f"[{VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in FINISHED:
        return w.lower()
    for end in ("eedly", "eed"):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                base = w[: -len(end)]
                if re.search(f"[{VOWEL}]", base):
                    if base.endswith(("at", "bl", "iz")):
                        w = base + "e"
                    elif base.endswith(DOUBLE):
                        w = base[:-1]
                    elif r1 >= len(base) and _short_end(base):
                        w = base + "e"
                    else:
                        w = base
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    for end, new in STEP_2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and not (end == "ogi" and w[at - 1 : at] != "l") and not (end == "li" and w[at - 1 : at] not in LI_BEFORE):
                w = w[:at] + new
            break
    for end, new in STEP_3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + new
            break
    for end in STEP_4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and not (end == "ion" and w[at - 1 : at] not in "st"):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
