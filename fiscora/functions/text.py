"""Column expressions on names, places and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Trailing words that mark a county-level area.
AREA_SUFFIXES = ("COUNTY", "PARISH", "BOROUGH", "MUNICIPALITY", "CENSUS AREA")

# Abbreviation pattern and replacement, applied in this order.
NAME_RULES = (
    (r"\bST\.?\b", "SAINT"),
    (r"\bMED CTR\b", "MEDICAL CENTER"),
    (r"\bMED\b", "MEDICAL"),
    (r"\bCTR\b", "CENTER"),
    (r"\bHOSP\b", "HOSPITAL"),
    (r"\bREGL\b", "REGIONAL"),
    (r"\bREG\b", "REGIONAL"),
    (r"\bMEM\b", "MEMORIAL"),
    (r"\bCOMM\b", "COMMUNITY"),
    (r"\bGEN\b", "GENERAL"),
)

# Fixed value: everything that is not a capital letter, digit or white space.
PUNCTUATION = r"[^A-Z0-9\s]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper_trim(c: Column | str) -> Column:
    return F.upper(F.trim(_col(c)))


def normalize_county(c: Column | str, suffixes: Sequence[str] = AREA_SUFFIXES) -> Column:
    """Upper-case place name without its area-type ending."""
    ending = rf"\s*({'|'.join(suffixes)})\s*$"
    return F.trim(F.regexp_replace(upper_trim(c), ending, ""))


def normalize_county_simple(c: Column | str, ending: str = " COUNTY") -> Column:
    """Upper-case place name with every literal ``ending`` removed."""
    return F.trim(F.replace(F.upper(_col(c)), F.lit(ending), F.lit("")))


def normalize_name(c: Column | str, rules: Sequence[tuple[str, str]] = NAME_RULES,
                   strip: str = PUNCTUATION) -> Column:
    """Expand abbreviations in rule order, then drop punctuation.

    The first default rule also rewrites "ST" meaning street; pass other
    ``rules`` where that matters.
    """
    name = upper_trim(c)
    for pattern, replacement in rules:
        name = F.regexp_replace(name, pattern, replacement)
    return F.regexp_replace(name, strip, "")


def prefix_key(c: Column | str, n: int = 4, collapse_blanks: bool = False) -> Column:
    """First ``n`` words of the punctuation-free name, joined by one blank.

    A removed "&" leaves two blanks and therefore an empty word; with
    ``collapse_blanks`` such empty words no longer use up a place.
    """
    bare = F.regexp_replace(upper_trim(c), PUNCTUATION, "")
    if collapse_blanks:
        bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.array_join(F.slice(F.split(bare, " "), 1, n), " ")


def fiscal_year(c: Column | str, fmt: str = "MM/dd/yyyy") -> Column:
    """Year of a date text; text that is no such date gives NULL."""
    return F.year(F.try_to_date(_col(c), fmt))


def zero_pad(c: Column | str, n: int) -> Column:
    """Left-pad a key with zeros; longer keys are kept whole, never cut."""
    text = _col(c).cast("string")
    return F.when(F.length(text) >= n, text).otherwise(F.lpad(text, n, "0"))


def fy_label(c: Column | str, prefix: str = "FY") -> Column:
    return F.concat(F.lit(prefix), _col(c).cast("string"))
