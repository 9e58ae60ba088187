"""Supplier-name helpers: matching keys, search names, brand words and slugs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from labelspark import constants as C


def any_word(alternatives: list[str]) -> str:
    """A pattern for whole words where only ASCII letters, digits and ``_`` count as word characters.

    Java's own word boundary also counts umlauts, which would keep ``eg`` in ``büeg``.
    """
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(alternatives) + r")(?![A-Za-z0-9_])"


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


# a test of the first letter is cheaper than the word boundary before it
_LEGAL_FORM = f"(?=[{''.join(sorted({form[0] for form in C.LEGAL_FORMS}))}])" + any_word(C.LEGAL_FORMS)
# Every run of other characters than a-z, 0-9, ä, ö, ü, ß.  As one class with the umlauts in it Java takes five times as long.
_NOT_IN_KEYS = r"(?:(?![äöüß])[^a-z0-9])+"


def match_key(name: Column) -> Column:
    """The key under which two spellings of one supplier meet."""
    without_form = F.regexp_replace(F.lower(name), _LEGAL_FORM, "")
    return F.regexp_replace(without_form, _NOT_IN_KEYS, "")


def search_name(name: Column) -> Column:
    """The name as typed into a search engine."""
    without_form = F.regexp_replace(name, "(?i)" + any_word(C.LEGAL_FORMS), "")
    plain = F.regexp_replace(without_form, r"[^a-zA-Z0-9äöüÄÖÜß\s\-&]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def brand_words(name: Column) -> Column:
    """The words of a name that identify a supplier (longer than two characters)."""
    text = F.regexp_replace(F.lower(name), any_word(C.LABEL_KEYWORDS), "")
    text = F.regexp_replace(text, any_word(["pdf"]), "")
    text = F.regexp_replace(text, any_word(C.NAME_STOP_TERMS), "")
    words = F.transform(F.split(text, r"[\s,.\-/&()]+"), lambda w: F.regexp_replace(w, _NOT_IN_KEYS, ""))
    return F.filter(words, lambda w: F.length(w) > 2)


def slug(name: Column) -> Column:
    """A name usable in a path."""
    text = F.lower(name)
    for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(umlaut), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]+", "-"), r"^-|-$", "")
