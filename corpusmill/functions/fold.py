"""Text folding. Each normaliser has its own rule on purpose; they are Column expressions that Catalyst compiles."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound


@cache
def _plain(form: str) -> dict[str, str]:
    """Every letter that decomposes into one letter and accents, in all scripts, and that letter."""
    pairs = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        base = "".join(c for c in unicodedata.normalize(form, char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            pairs[char] = base.lower()
    return pairs


def _translated(text: Column, form: str) -> Column:
    table = _plain(form)
    return F.translate(text, "".join(table), "".join(table.values()))


def folded(text: str) -> str:
    """What fold() makes of a text, for a query's words."""
    return re.sub("[\u0300-\u036f]", "", text.lower().translate(str.maketrans(_plain("NFD"))))


def fold(text: Column) -> Column:
    """Search fold: accents off, lower case; white space stays."""
    return F.regexp_replace(_translated(F.lower(text), "NFD"), "[\\u0300-\\u036F]", "")


def _strong(text: Column) -> Column:
    return F.replace(F.regexp_replace(_translated(F.lower(text), "NFKD"), "\\p{M}", ""), F.lit("ß"), F.lit("ss"))


def norm(text: Column) -> Column:
    """Name fold: compatibility letters and accents off, case off, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(_strong(text), "(?U)\\s+", " "))


def norm_label(text: Column) -> Column:
    """Label fold: like norm, with everything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(_strong(text), "[^a-z0-9]+", " "))


def terms(text: Column) -> Column:
    """Folded runs of letters and digits: the tokens of both search dialects."""
    return F.regexp_extract_all(fold(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def query_words(text: Column) -> Column:
    """Unfolded word runs (underscore included)."""
    return F.regexp_extract_all(text, F.lit("(?U)\\w+"), F.lit(0))


def safe_file(name: Column, fallback: str = "sem_nome") -> Column:
    """A name without illegal file characters, collapsed, without spaces and dots at its ends."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), '[<>:"/\\\\|?*\\x00-\\x1f]', "_"), "(?U)\\s+", " ")
    return F.coalesce(F.nullif(F.btrim(clean, F.lit(" .")), F.lit("")), F.lit(fallback))


def safe_folder(name: Column) -> Column:
    return F.regexp_replace(name, '[\\\\/:*?"<>|]', "_")


__all__ = ["bound", "fold", "folded", "norm", "norm_label", "query_words", "safe_file", "safe_folder", "terms"]
