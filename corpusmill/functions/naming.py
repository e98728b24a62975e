"""Names of files, folders, levels and acts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import norm, safe_file, safe_folder

# Words that may not end an act's folder name.
LOOSE_WORDS = ("A", "O", "AS", "OS", "E", "DE", "DA", "DO", "DAS", "DOS", "EM", "NA", "NO", "NAS", "NOS", "AO", "AOS", "OU", "COM", "SEM", "POR")
# File types and their extensions.
TYPES = {"pdf": ".pdf", "gdoc": ".txt", "docx": ".docx", "doc": ".doc"}
# Folder names of the second level, folded.
SECOND_LEVEL = (
    "voto dos relatores", "votos dos relatores", "voto de relatores", "votos de relatores", "voto relatores", "votos relatores",
    "voto dos relatores(as)", "votos dos relatores(as)", "voto dos relatres", "votos dos relatres",
    "voto das relatoras", "votos das relatoras", "votos relatoras",
)
SECOND_MARKS = ("relator", "relatores", "relatora", "relatoras", "relatres")
ACT_WORDS, ACT_CHARS = 7, 120


def is_first_level(name: Column) -> Column:
    """A numbered session, 001 to 999."""
    number = F.regexp_extract(norm(name), "^sessao[^\\d]+(\\d{3})\\b", 1)
    return (number != "") & F.coalesce(F.try_to_number(F.nullif(number, F.lit("")), F.lit("999")).cast("int"), F.lit(0)).between(1, 999)


def is_second_level(name: Column) -> Column:
    """A folder of votes: one of the fixed names, or the word for vote with a rapporteur."""
    folded = norm(name)
    marked = F.lit(False)
    for mark in SECOND_MARKS:
        marked = marked | folded.contains(mark)
    return folded.isin(*SECOND_LEVEL) | (folded.rlike("\\bvotos?\\b") & marked)


def level_label(level: Column, default: Column) -> Column:
    return F.when(level.startswith("1"), F.lit("1a instancia")).when(level.startswith("2"), F.lit("2a instancia")).otherwise(default)


def with_extension(name: Column, extension: Column) -> Column:
    """The name with its type's extension, unless it has it in any case."""
    return F.when(F.lower(name).endswith(extension), name).otherwise(F.concat(name, extension))


def raw_name(name: Column, file_id: Column, extension: Column) -> Column:
    """`stem - id.ext` with a stem of 140 and an id of 8 characters at most."""
    stem = F.regexp_replace(name, "\\.[^./]+$", "")
    return F.concat(F.left(stem, F.lit(140)), F.lit(" - "), F.left(file_id, F.lit(8)), extension)


def extension(path: Column) -> Column:
    """The last suffix in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))


def act_folder(act: Column) -> Column:
    """The first words of an act in upper case, without numbers and loose words at the end."""
    clean = F.regexp_replace(safe_folder(F.upper(act)), "(?iu)\\bAFERIDA\\w*", " ")
    clean = F.regexp_replace(F.regexp_replace(clean, "\\d[\\d.,]*\\d|\\d", " "), "\\s+([,.;:])", "$1")
    words = F.slice(F.filter(F.split(F.trim(clean), "(?U)\\s+"), lambda w: w != ""), 1, ACT_WORDS)
    loose = lambda w: F.regexp_replace(w, "[^\\p{L}\\p{N}]", "").isin(*LOOSE_WORDS)
    # the last word that may stand at the end; the first word always may
    last = F.aggregate(F.transform(words, lambda w, i: F.when((i == 0) | ~loose(w), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    name = F.btrim(F.array_join(F.slice(words, 1, F.greatest(last, F.lit(1))), " "), F.lit(" .,_"))
    return F.when(F.length(name) > ACT_CHARS, F.regexp_replace(F.left(name, F.lit(ACT_CHARS)), "[ .,_]+$", "")).otherwise(name)


def law_folder(law: Column) -> Column:
    return safe_folder(F.coalesce(F.nullif(law, F.lit("")), F.lit("SEM LEI")))


__all__ = ["act_folder", "extension", "is_first_level", "is_second_level", "law_folder", "level_label", "raw_name", "safe_file", "with_extension"]
