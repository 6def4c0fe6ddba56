"""Text normalisation and name keys, built from Spark string and array functions."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from antecede.functions.constants import (
    BLANK_WORDS,
    NAME_SUFFIXES,
    OLD_TEAM_CODES,
    TEAM_CODES,
)
from antecede.functions.expr import as_col, lookup


@cache
def _compatible() -> tuple[tuple[str, str], ...]:
    """Characters outside ASCII that have a lower compatibility form, with that form, combining marks removed.

    Only the first two planes have forms with ASCII letters or digits in them.
    """
    pairs = []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        letter = chr(code)
        if unicodedata.decomposition(letter) or letter.lower() != letter:
            base = unicodedata.normalize("NFKD", letter.lower())
            pairs.append((letter, base if base.isascii() else "".join(c for c in base if not unicodedata.combining(c))))
    return tuple(pairs)


@cache
def _plain_letters() -> tuple[str, str]:
    """Rule: every letter whose compatibility form is one ASCII letter or digit."""
    source, target = [], []
    for letter, base in _compatible():
        if len(base) == 1 and base.isascii() and base.isalnum():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


@cache
def _marks() -> str:
    """Rule: every combining mark of the first two planes, where all of them are."""
    return "".join(chr(code) for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000)] if unicodedata.combining(chr(code)))


@cache
def _letter_groups() -> tuple[tuple[str, str], ...]:
    """Rule: characters whose compatibility form is longer and holds an ASCII letter or digit; all
    else in the form becomes a blank."""
    pairs = []
    for letter, base in _compatible():
        plain = "".join(c if c.isascii() and c.isalnum() else " " for c in base)
        if len(base) > 1 and plain.strip():
            pairs.append((letter, plain))
    return tuple(pairs)


def normalize_text(value) -> Column:
    """Lower case, no accents, runs of anything but a-z and 0-9 become one space; never NULL."""
    source, target = _plain_letters()
    text = F.lower(as_col(value))
    # Plain ASCII, by far the most names, skips the letter tables.
    text = F.when(
        F.octet_length(text) > F.char_length(text),
        _once(F.translate(text, source + _marks(), target), _long_forms),  # marks have no target and go
    ).otherwise(text)
    return F.coalesce(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), F.lit(""))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _long_forms(text: Column) -> Column:
    """Letters with longer forms replaced, one by one; only texts that hold one come this far.

    Whether a text holds one is seen by taking them all out, one table look-up per character.
    """
    forms = dict(_letter_groups())
    table = F.from_json(F.lit(json.dumps(forms)), "map<string,string>")  # folded to one constant
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    replaced = F.array_join(F.transform(characters, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(F.char_length(F.translate(text, "".join(forms), "")) < F.char_length(text), replaced).otherwise(text)


def first_last(value) -> Column:
    """"Last, First" turned into "First Last"; other text is only trimmed."""
    pieces = F.filter(
        F.transform(F.split(as_col(value), ","), lambda part: F.trim(part)),
        lambda part: part != "",
    )

    def swapped(pieces: Column) -> Column:
        return F.when(
            F.size(pieces) >= 2,
            F.concat_ws(" ", F.slice(pieces, F.lit(2), F.size(pieces)), F.element_at(pieces, 1)),
        ).otherwise(F.trim(as_col(value)))

    return F.when(as_col(value).contains(","), _once(pieces, swapped)).otherwise(F.trim(as_col(value)))


def last_first(value) -> Column:
    """"First Last" turned into "Last, First" on the final blank; other text is kept."""
    text = F.trim(as_col(value))
    return F.when(
        text.contains(",") | ~text.contains(" "), text
    ).otherwise(F.regexp_replace(text, r"^(.*\S)\s+(\S+)$", "$2, $1"))


def name_aliases(value) -> Column:
    """Sorted distinct spellings: as written, comma-swapped, and each without suffixes.

    Functions of arrays are interpreted, so nothing that is read several times may be written out several times: the
    text is split, swapped and normalised once.
    """
    suffixes = F.array(*[F.lit(s) for s in NAME_SUFFIXES])

    def shortened(s: Column) -> Column:
        return F.array_join(F.filter(F.split(s, " "), lambda t: ~F.array_contains(suffixes, t)), " ")

    spellings = F.array(normalize_text(value), _once(first_last(value), normalize_text))
    both = _once(spellings, lambda known: F.concat(known, F.transform(known, shortened)))
    return F.sort_array(F.array_distinct(F.filter(both, lambda s: s != "")))


def name_keys(aliases) -> Column:
    """Keys under which two names count as the same person.

    ``a:`` whole alias, ``t:`` set of at least two words, ``l:`` last word plus first initial.
    Two names match exactly when they share a key, so matching is an equi-join.
    """
    spellings = as_col(aliases)
    whole = F.transform(spellings, lambda s: F.concat(F.lit("a:"), s))
    words = F.transform(
        F.filter(spellings, lambda s: F.size(F.split(s, " ")) >= 2),
        lambda s: F.concat(
            F.lit("t:"), F.array_join(F.sort_array(F.array_distinct(F.split(s, " "))), " ")
        ),
    )
    last = F.transform(
        spellings,
        lambda s: F.concat(
            F.lit("l:"), F.element_at(F.split(s, " "), -1), F.lit("|"), F.substring(s, 1, 1)
        ),
    )
    return F.array_distinct(F.concat(whole, words, last))


def last_words(aliases) -> Column:
    return F.array_distinct(
        F.transform(as_col(aliases), lambda s: F.element_at(F.split(s, " "), -1))
    )


def team_code(value) -> Column:
    """Team abbreviation of a code or full team name; empty text where unknown."""
    codes = {code: code for code in TEAM_CODES} | OLD_TEAM_CODES
    names = {name: code for code, listed in TEAM_CODES.items() for name in listed}
    upper = F.upper(F.trim(as_col(value)))
    return F.coalesce(
        lookup(codes, upper), lookup(names, normalize_text(value)), F.lit("")
    )


def normalize_flags(value) -> Column:
    """Flag text with every blank-like spelling turned into NONE."""
    text = F.trim(as_col(value))
    return F.when(
        text.isNull() | (text == "") | F.lower(text).isin(*BLANK_WORDS), F.lit("NONE")
    ).otherwise(text)
