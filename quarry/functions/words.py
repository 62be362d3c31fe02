"""Words, terms and queries: tokenizers, stopwords, sanitizing, stemming; as Columns where possible."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that searches leave out (unless a query has no others).
STOPWORDS = frozenset(
    "the and for are but not you all can had her was one our out has his how its may new now old see way who did get got let say she too use will with this that from they been have many some them than each make "
    "like just over such take into year your good could would about which their there other after should through also more most only very when what then these those being does done both same still while where here were much "
    "update updates updated deps dev tests test add added fix fixed run running using".split()
)
#: Characters of the query language, which queries lose.
SPECIAL = "'\"(){}[]*:^~`"
_OPERATORS = ("and", "or", "not", "near")


def tokens(c: Column | str) -> Column:
    """Index tokens: lower case, runs of letters and digits ('_' and '-' separate)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def vocabulary_words(c: Column | str) -> Column:
    """Words for the vocabulary: '_' and '-' stay inside, at least 3 characters, no stopwords."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_-]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*sorted(STOPWORDS)))


def query_terms(c: Column | str) -> Column:
    """Terms of a query: special characters to blanks, operators dropped, first of equal words kept, stopwords dropped unless all are."""
    c = F.col(c) if isinstance(c, str) else c
    words = F.filter(F.split(F.translate(F.lower(c), SPECIAL, " " * len(SPECIAL)), r"\s+"), lambda w: (w != "") & ~w.isin(*_OPERATORS))
    words = F.array_distinct(words)
    kept = F.filter(words, lambda w: ~w.isin(*sorted(STOPWORDS)))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def trigram_terms(c: Column | str) -> Column:
    """Terms of a substring query: special characters deleted, words of at least 3 characters."""
    c = F.col(c) if isinstance(c, str) else c
    words = F.filter(F.split(F.translate(F.lower(c), SPECIAL, ""), r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*_OPERATORS))
    words = F.array_distinct(words)
    kept = F.filter(words, lambda w: ~w.isin(*sorted(STOPWORDS)))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def most_edits(c: Column) -> Column:
    """Edits within which a word is corrected: 1 up to 4 characters, 2 up to 12, else 3."""
    return F.when(F.length(c) <= 4, 1).when(F.length(c) <= 12, 2).otherwise(3)


def plain_tokens(text: str) -> list[str]:
    """Index tokens in Python, with diacritics removed."""
    flat = "".join(ch for ch in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(ch))
    return re.findall(r"[^\W_]+", flat)


_VOWEL = re.compile(r"[aeiou]")


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences; y is a vowel after a consonant."""
    kinds = "".join("v" if ch in "aeiou" or (ch == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, ch in enumerate(stem))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return any(ch in "aeiou" or (ch == "y" and i) for i, ch in enumerate(stem))


def _cvc(stem: str) -> bool:
    if len(stem) < 3:
        return False
    a, b, c = stem[-3:]
    vowel_b = b in "aeiou" or (b == "y" and a not in "aeiou")
    return a not in "aeiou" and vowel_b and c not in "aeiouwxy"


# Suffix tables of the public 1980 algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The Porter stem of a lower-case word."""
    w = word
    if len(w) <= 2 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix, by in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + by
                break
    for suffix in sorted(_STEP4, key=lambda x: -len(x)):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def index_tokens(text: str, stemmed: bool = True) -> list[str]:
    """Index tokens: small letters, no diacritics, runs of letters and digits, stems."""
    words = plain_tokens(text)
    return [stem(w) for w in words] if stemmed else words


def distinct_in_order(words: Iterable[str]) -> list[str]:
    """Words whose lower case wasn't there before, in the spelling seen first."""
    seen: set[str] = set()
    return [w for w in words if not (w.lower() in seen or seen.add(w.lower()))]
