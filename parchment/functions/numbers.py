"""Numbers as French words, by rule."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
UNITS = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize".split()
TENS = {2: "vingt", 3: "trente", 4: "quarante", 5: "cinquante", 6: "soixante"}
PREFIXES = "m b tr quadr quint sext sept oct non déc".split()
SCALES = tuple((10 ** (6 * k + 3 * half), p + ("illiard" if half else "illion")) for k, p in reversed(list(enumerate(PREFIXES, 1))) for half in (1, 0))
LONGEST = 66  # digits that have a name; longer numbers are read digit by digit
NUMBER = re.compile(r"\d+(?:[\s.,]\d+)*")


def _below_hundred(n: int, last: bool) -> str:
    if n <= 16:
        return UNITS[n]
    if n < 20:
        return "dix-" + UNITS[n - 10]
    if n < 70:
        ten, unit = divmod(n, 10)
        return TENS[ten] + ("" if not unit else " et un" if unit == 1 else "-" + UNITS[unit])
    if n < 80:
        return "soixante et onze" if n == 71 else "soixante-" + _below_hundred(n - 60, last)
    return ("quatre-vingts" if last else "quatre-vingt") if n == 80 else "quatre-vingt-" + _below_hundred(n - 80, last)


def _below_thousand(n: int, last: bool) -> str:
    hundreds, rest = divmod(n, 100)
    if not hundreds:
        return _below_hundred(rest, last)
    head = "cent" if hundreds == 1 else UNITS[hundreds] + (" cents" if not rest and last else " cent")
    return head + (" " + _below_hundred(rest, last) if rest else "")


def spell(n: int) -> str:
    """French words of a whole number from 0."""
    if n < 1000:
        return _below_thousand(n, True)
    parts = []
    for size, name in SCALES:
        count, n = divmod(n, size)
        if count:
            parts.append(f"{spell(count)} {name}{'s' if count > 1 else ''}")
    thousands, rest = divmod(n, 1000)
    if thousands:
        parts.append("mille" if thousands == 1 else _below_thousand(thousands, False) + " mille")
    if rest:
        parts.append(_below_thousand(rest, True))
    return " ".join(parts)


def _spoken(m: re.Match) -> str:
    digits = re.sub(r"\D", "", m[0])
    return spell(int(digits)) if len(digits) <= LONGEST else " ".join(UNITS[int(d)] for d in digits)


def spell_all(text: str | None) -> str | None:
    """Digit groups in a text, joined over one space, stop or comma, put in words. No digit is left."""
    return text and NUMBER.sub(_spoken, text)


def spelled_numbers(c: Column) -> Column:
    """No primitive calls back from a regular expression, so this runs in Arrow batches; texts without digits pass by."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(spell_all, na_action="ignore")

    return F.when(c.rlike(r"\p{Nd}"), run(c)).otherwise(c)
