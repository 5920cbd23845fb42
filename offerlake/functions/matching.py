"""How well a candidate's name matches the expected one, from 0 to 100.

The rules compare the names in ever looser forms; the first that holds gives the score.
One row needs no other row, so Spark runs them as a pandas UDF over Arrow batches. A name
stands in many pairs, so a worker keeps the forms of the names it has met, up to a bound.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType

from offerlake.functions.text import ABBREVIATIONS, CLEANING, PRODUCER_SUFFIXES, VARIANTS

# The scores depend on them.
ORDINALS = {
    "1st": "first", "2nd": "second", "3rd": "third", "4th": "fourth", "5th": "fifth", "6th": "sixth", "7th": "seventh",
    "8th": "eighth", "9th": "ninth", "10th": "tenth", "11th": "eleventh", "12th": "twelfth", "13th": "thirteenth",
    "14th": "fourteenth", "15th": "fifteenth", "16th": "sixteenth", "17th": "seventeenth", "18th": "eighteenth",
    "19th": "nineteenth", "20th": "twentieth", "21st": "twentyfirst", "25th": "twentyfifth", "30th": "thirtieth",
}
NUMBER_WORDS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "ten": "10", "ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9",
}
ROMAN_SIGNS = {
    "Ⅰ": "1", "Ⅱ": "2", "Ⅲ": "3", "Ⅳ": "4", "Ⅴ": "5", "Ⅵ": "6", "Ⅶ": "7", "Ⅷ": "8", "Ⅸ": "9", "Ⅹ": "10",
    "ⅰ": "1", "ⅱ": "2", "ⅲ": "3", "ⅳ": "4", "ⅴ": "5", "ⅵ": "6", "ⅶ": "7", "ⅷ": "8", "ⅸ": "9", "ⅹ": "10",
}
#: Endings that stay although they end in s.
NO_PLURALS = ("ss", "us", "is", "as", "os", "ys")
NOISE = (
    "barrel", "aged", "sour", "ale", "stout", "ipa", "collaborat", "batch", "edition", "series", "vol", "ver", "double",
    "triple", "imperial", "hazy", "neipa", "shigakogen", "tamamura", "honten", "fresh", "hop", "wet", "dry", "anniversary",
    "year",
)
DESCRIBING = ("sour", "ale", "stout", "ipa", "lager", "pilsner")
#: Style words that an expected name may not have alone where the candidate is an IPA.
NOT_IPA = ("weizen", "stout", "porter", "pilsner")
#: Products of one producer that share a word and aren't the same: the word, and what marks the other product - a part of its
#: key, a word, and a word that marks it only beside the first. Fixed values.
CLASHING = [("engi", "engiland", "land", "new")]
CORE_STYLES = (
    "Sake IPA", "Sake Ale", "Rice Ale", "Sake", "IPA", "DIPA", "TIPA", "Hazy IPA", "Double IPA", "Triple IPA", "NEIPA",
    "West Coast IPA", "Session IPA", "Stout", "Imperial Stout", "Pale Ale", "Lager", "Pilsner", "Sour", "Porter", "Ale",
    "Saison", "Gose",
)
CLOSE, TYPO = 0.78, 0.82
#: Names whose forms a worker keeps; bounds its memory only.
KEPT_NAMES = 1 << 15

_WORD = re.compile(r"\b[a-zA-Z]+\b")
_DATED = re.compile(r"\s*[(\[（]\s*(?:20)?\d{2}(?:[./-]\d{1,2})?\s*[)\]）]\s*")
_END_DATE = re.compile(r"\s+(?:20)?\d{2}[./-]\d{1,2}$")
_BRACKETS = re.compile(r"[（(]([^）)]*)[）)]")
_CLEANING = [(re.compile(pattern), put) for pattern, put in CLEANING]
_END_STYLE = re.compile(rf"\s+(?:{'|'.join(sorted(CORE_STYLES, key=len, reverse=True))})\s*$", re.I)
_COLLABORATORS = re.compile(r"\s+(?:x|X|with)\s+|\s*[×&/+]\s*|\s*w/\s*")


def key(name: str | None) -> str:
    return "".join(c for c in name or "" if c.isalnum()).lower()


_VARIANT_KEYS = tuple(dict.fromkeys(key(v) for v in VARIANTS))


def expand(name: str) -> str:
    name = re.sub(r"\bLR\s*(\d+)\b", r"Limited Release \1", name, flags=re.I)
    return re.sub(rf"\b(?:{'|'.join(ABBREVIATIONS)})\b", lambda m: ABBREVIATIONS[m[0].lower()], name, flags=re.I)


def ordinals(name: str) -> str:
    return re.sub(r"\b\d+(?:st|nd|rd|th)\b", lambda m: ORDINALS.get(m[0].lower(), m[0]), name, flags=re.I)


def digits(name: str) -> str:
    signs = "".join(ROMAN_SIGNS.get(c, c) for c in name)
    return _WORD.sub(lambda m: NUMBER_WORDS.get(m[0].lower(), m[0]), signs)


def _singular(word: str) -> str:
    low, n = word.lower(), len(word)
    if n > 4 and low.endswith("ies"):
        return word[:-3] + "y"
    if n > 4 and low.endswith(("xes", "zes", "ses", "hes")):
        return word[:-2]
    return word[:-1] if n > 3 and low.endswith("s") and not low.endswith(NO_PLURALS) else word


def singulars(name: str) -> str:
    return _WORD.sub(lambda m: _singular(m[0]), name)


def clean(name: str) -> str:
    """The name without series, dates, containers, treatments, notes and styles: `CLEANING`, rule by rule."""
    for pattern, put in _CLEANING:
        name = pattern.sub(put, name)
    return " ".join(name.split())


def core(name: str) -> str:
    """The name without dates, dashes, what follows a colon, and its style, unless too little is left."""
    whole = re.sub(r"\s*[–—-]\s*", " ", _END_DATE.sub(" ", _DATED.sub(" ", name))).split(":")[0].strip()
    short = _END_STYLE.sub("", whole).strip()
    title = len(short) <= 4 and len(short.split()) == 1 and len(whole.split()) == 2
    return whole if len(short) <= 3 or title else short


@lru_cache(maxsize=KEPT_NAMES)
def variants(name: str) -> frozenset[str]:
    own = key(expand(name))
    return frozenset(v for v in _VARIANT_KEYS if v in own)


def variants_differ(candidate: str, expected: str) -> bool:
    """Whether one has a variant that the other lacks.

    An expected name without variants may be the beginning of a candidate whose further
    words have its variants or a style: then they only describe it.
    """
    one, two = variants(candidate), variants(expected)
    if one == two:
        return False
    long, short = key(candidate), key(expected)
    if two or len(short) < 4 or not long.startswith(short):
        return True
    return not any(word in long[len(short) :] for word in (*one, *DESCRIBING))


def alike(a: str, b: str, producer: str | None = None) -> bool:
    """Whether one key holds the other and the rest is little, or noise, or the producer."""
    short, long = sorted((a, b), key=len)
    if a == b or len(short) < 3 or short not in long:
        return bool(a) and a == b
    if 2 * len(short) / (len(short) + len(long)) >= CLOSE:  # their ratio, as one holds the other
        return True
    rest = re.sub(r"\b20\d{2}\b", "", long.replace(short, ""))
    maker = key(producer)
    words = [w for w in re.findall("[a-z0-9]+", (producer or "").lower()) if len(w) >= 3]
    return any(n in rest for n in NOISE) or bool(maker) and (maker in rest or rest in maker) or any(w in rest for w in words)


def strip_producer(name: str) -> str:
    for suffix in sorted(PRODUCER_SUFFIXES, key=len, reverse=True):
        if name.lower().endswith(f" {suffix.lower()}"):
            return name[: -len(suffix) - 1].strip()
    return name.strip()


@lru_cache(maxsize=KEPT_NAMES)
def producers_agree(candidate: str | None, expected: str | None) -> bool:
    """Whether two producers can be one, or one of those who collaborated; unknown ones agree."""
    if not candidate or not expected:
        return True
    a, b = key(candidate), key(expected)
    if a in b or b in a:
        return True
    one, two = strip_producer(candidate), strip_producer(expected)
    a, b = key(one), key(two)
    if a and a == b:
        return True
    if a and len(b) >= 4 and (a in b or b in a):
        # the expected name stands in the candidate's as whole words, or next to nothing is left
        if re.search(rf"\b{re.escape(two.lower())}\b", one.lower()) or alike(a, b):
            return True
    parts = [key(p) for p in _COLLABORATORS.split(expected)]
    return len(parts) > 1 and any(p and (p in key(candidate) or key(candidate) in p) for p in parts)


def _words(text: str | None) -> set[str]:
    return set(re.findall("[a-z0-9]+", (text or "").lower()))


def _names_clash(candidate: str, expected: str) -> bool:
    """Whether one name is a product of `CLASHING` and the other is the one that it shares a word with."""
    for shared, part, word, beside in CLASHING:
        marks = [(part in key(name) or word in _words(name), beside in _words(name)) for name in (candidate, expected)]
        (strong, weak), (wanted, wanted_weak) = marks
        if shared in _words(expected) and (shared not in _words(candidate) or ((strong or weak) and not wanted)):
            return True
        if shared in _words(candidate) and (wanted or wanted_weak) and not strong:
            return True
    return False


def _styles_clash(candidate: str, expected: str, style: str | None) -> bool:
    missing = (_words(expected) & set(NOT_IPA)) - _words(candidate) - _words(style)
    return "ipa" in _words(style) and bool(missing)


def _parts(name: str) -> list[str]:
    inner = [p.strip() for p in _BRACKETS.findall(name)]
    return list(dict.fromkeys(p for p in (name, _BRACKETS.sub(" ", name).strip(), *inner) if p))


#: The forms that are compared, loosest last, with the scores of equal and of similar keys.
FORMS: list[tuple[Callable[[str], str], int, int]] = [
    (lambda n: n, 100, 90),
    (expand, 95, 88),
    (ordinals, 85, 80),
    (digits, 85, 80),
    (singulars, 85, 80),
    (lambda n: core(clean(n)), 75, 70),
    (lambda n: core(singulars(digits(ordinals(clean(n))))), 60, 60),
]
CORE_FORM = 5


@lru_cache(maxsize=KEPT_NAMES)
def _forms(name: str) -> tuple[str, ...]:
    return tuple(key(form(name)) for form, _, _ in FORMS)


@lru_cache(maxsize=KEPT_NAMES)
def _part_keys(name: str) -> tuple[str, ...]:
    """Keys of a name's parts, where they are long enough to mean something."""
    keys = [key(core(part)) for part in _parts(clean(name))]
    return tuple(k for k in keys if len(k) >= (3 if k.isascii() else 2))


def _nearly(a: str, b: str) -> bool:
    """Whether two keys differ by a typing error; bounds of the ratio go first, as they are cheap."""
    if min(len(a), len(b)) < 4 or 2 * min(len(a), len(b)) < TYPO * (len(a) + len(b)):
        return False
    matcher = SequenceMatcher(None, a, b)
    return matcher.quick_ratio() >= TYPO and matcher.ratio() >= TYPO


def score(candidate: str | None, producer: str | None, style: str | None, expected: str | None, maker: str | None) -> int:
    """The score of a candidate (name, producer, style) for an expected name and maker."""
    if not expected:
        return 100
    if not candidate or not producers_agree(producer, maker) or variants_differ(candidate, expected):
        return 0
    ours, theirs = _forms(candidate), _forms(expected)
    if not ours[0] or not theirs[0]:
        return 0
    if ours[0] != theirs[0] and (_styles_clash(candidate, expected, style) or _names_clash(candidate, expected)):
        return 0
    forms = [(a, b, equal, near) for a, b, (_, equal, near) in zip(ours, theirs, FORMS, strict=True)]
    # equal plain or expanded names come before any that are only similar
    for a, b, equal, _ in forms[:2]:
        if a == b:
            return equal
    for a, b, equal, near in forms:
        if a and a == b:
            return equal
        if a and b and alike(a, b, maker):
            return near
    if any(alike(a, b, maker) for a in _part_keys(candidate) for b in _part_keys(expected)):
        return 75
    return 70 if _nearly(ours[CORE_FORM], theirs[CORE_FORM]) else 0


@F.pandas_udf(IntegerType())
def match_score(candidate: pd.Series, producer: pd.Series, style: pd.Series, expected: pd.Series, maker: pd.Series) -> pd.Series:
    rows = zip(*(s.where(s.notna(), None) for s in (candidate, producer, style, expected, maker)), strict=True)
    return pd.Series([score(*row) for row in rows], dtype="int32")


@F.pandas_udf(BooleanType())
def producers_match(candidate: pd.Series, expected: pd.Series) -> pd.Series:
    """Whether two producers can be one; unknown ones agree."""
    rows = zip(*(s.where(s.notna(), None) for s in (candidate, expected)), strict=True)
    return pd.Series([producers_agree(*row) for row in rows], dtype="bool")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all of them, by longest common blocks; null if either is."""
    return pd.Series(
        [None if pd.isna(x) or pd.isna(y) else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64"
    )
