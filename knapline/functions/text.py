"""Parsers of the short free texts that come with specimens and sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in notes, common misspellings included, and the letters that stand for them, in the order in
# which they are tried.
NOTE_LETTERS = {
    "handaxe": "h",
    "cleaver": "c",
    "discoid": "d",
    "dicoid": "d",
    "trihedral": "t",
    "pick": "p",
    "scraper": "s",
    "scaper": "s",
}
FLAKE_PHRASE, FLAKE_LETTER = "on a flake", "f"


def note_letter(part: Column) -> Column:
    """The letter of the first known word within a part, null if none is."""
    out = F.lit(None).cast("string")
    for word, letter in reversed(NOTE_LETTERS.items()):
        out = F.when(part.contains(word), F.lit(letter)).otherwise(out)
    return out


def parse_note(note: Column) -> Column:
    """Letters of a note's parts, joined by '/', each once. '-' if a part is unknown, null if the note is blank."""
    low = F.lower(F.trim(note))
    letters = F.transform(F.split(low, "/"), lambda p: note_letter(F.trim(p)))
    known = F.array_join(F.array_distinct(letters), "/")
    return F.when(low.isNull() | low.isin("", "nan", "none"), None).when(low.contains(FLAKE_PHRASE), FLAKE_LETTER).when(F.exists(letters, lambda x: x.isNull()), "-").otherwise(known)


def _mean(numbers: Column) -> Column:
    values = F.filter(F.transform(numbers, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def parse_age(text: Column) -> Column:
    """Thousands of years: the mean of all ages in Mya if there are any, else of all whole numbers in Kya."""
    mya = _mean(F.regexp_extract_all(text, F.lit(r"(?i)([0-9]+(?:\.[0-9]+)?)\s*mya"), 1))
    kya = _mean(F.regexp_extract_all(text, F.lit(r"(?i)([0-9]+)\s*kya"), 1))
    return F.coalesce(mya * 1000, kya)


def parse_altitude(text: Column) -> Column:
    """The mean of all numbers in a text."""
    return _mean(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1))


def site_key(text: Column) -> Column:
    """A site's name: what stands before a bracket, without spaces around and trailing dashes."""
    return F.rtrim(F.trim(F.split_part(text, F.lit("("), F.lit(1))), F.lit(" -_"))


def stem(path: Column) -> Column:
    """A path's last part without its suffix."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


def short_label(path: Column, size: int = 12) -> Column:
    return F.substring(stem(path), 1, size)
