"""Text cleaning: null tokens, Unicode trimming, column-name standardisation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that the usual CSV readers take as null (before trimming).
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Every character that Unicode counts as white space, plus the four separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def null_tokens(value: Column) -> Column:
    """Null for a cell whose whole text is a null token; other texts unchanged."""
    return F.when(~value.isin(*NULL_TOKENS), value)


def strip(value: Column) -> Column:
    """Trim all Unicode white space. A set-based trim is far cheaper than a regular expression."""
    return F.btrim(value, F.lit(WHITESPACE))


def snake_case(name: str) -> str:
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", re.sub(r"[^0-9A-Za-z]", "_", name))
    return "_".join(part for part in words.split("_") if part).lower()


def header_names(cells: Sequence[str]) -> list[str]:
    """Names of raw header cells: blanks become 'Unnamed: N', repeats get '.1', '.2'."""
    names: list[str] = []
    seen: set[str] = set()
    for position, cell in enumerate(cells):
        base = cell if cell else f"Unnamed: {position}"
        name, copy = base, 0
        while name in seen:
            copy += 1
            name = f"{base}.{copy}"
        seen.add(name)
        names.append(name)
    return names


def standard_names(names: Sequence[str]) -> list[str]:
    """Snake-case names, made unique with '_2', '_3' (Spark compares names without case)."""
    result: list[str] = []
    for position, name in enumerate(names):
        base = snake_case(name) or f"column_{position}"
        unique, copy = base, 1
        while unique in result:
            copy += 1
            unique = f"{base}_{copy}"
        result.append(unique)
    return result
