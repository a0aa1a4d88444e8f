"""Decoding of fixed-width position records and checks of track files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shortest record and file, and the share of a day that tells a midnight from a jitter.
RECORD_CHARS, FILE_BYTES, HALF_DAY_S = 35, 100, 43200


def is_record(line: Column) -> Column:
    return line.startswith("B") & (F.length(line) >= RECORD_CHARS)


def _number(text: Column) -> Column:
    """A signed whole number, null for anything else; a plain cast would end the job under ANSI rules."""
    return text.try_cast("int")


def seconds_of_day(line: Column) -> Column:
    h, m, s = (_number(F.substring(line, at, 2)) for at in (2, 4, 6))
    return F.when(h.between(0, 23) & m.between(0, 59) & s.between(0, 59), h * 3600 + m * 60 + s)


def angle(line: Column, start: int, degree_digits: int, positive: str, negative: str, limit: int) -> Column:
    """Degrees, thousandths of minutes and a hemisphere letter in any case; null if malformed or out of range."""
    degrees = _number(F.substring(line, start, degree_digits))
    minutes = _number(F.substring(line, start + degree_digits, 5))
    letter = F.upper(F.substring(line, start + degree_digits + 5, 1))
    value = degrees + minutes / F.lit(60000.0)
    good = (minutes < 60000) & letter.isin(positive, negative) & (value <= limit)
    return F.when(good, F.when(letter == negative, -value).otherwise(value))


def latitude(line: Column) -> Column:
    return angle(line, 8, 2, "N", "S", 90)


def longitude(line: Column) -> Column:
    return angle(line, 16, 3, "E", "W", 180)


def is_valid(line: Column) -> Column:
    return F.substring(line, 25, 1).isin("A", "a")


def altitude(line: Column, start: int) -> Column:
    return _number(F.substring(line, start, 5)).cast("double")


def file_lines(content: Column) -> Column:
    """Lines of a Latin-1 file under any line ending."""
    return F.split(F.decode(content, "ISO-8859-1"), "\r\n|\r|\n")


def looks_like_track(text_lines: Column, n_bytes: Column, record: str = "A", body: str = "B", least: int = FILE_BYTES) -> Column:
    """Long enough, the first line that is not blank starts as a header, and some line starts as a position."""
    filled = F.filter(text_lines, lambda x: F.trim(x) != "")
    return (n_bytes >= least) & F.coalesce(F.trim(F.get(filled, F.lit(0))).startswith(record), F.lit(False)) & F.exists(text_lines, lambda x: x.startswith(body))


def file_problem(text_lines: Column, n_bytes: Column, **kinds) -> Column:
    """too_small, invalid_structure, or null for a sound file."""
    least = kinds.get("least", FILE_BYTES)
    return F.when(n_bytes < least, "too_small").when(~looks_like_track(text_lines, n_bytes, **kinds), "invalid_structure")


def entry_kind(name: Column, extension: str = ".igc") -> Column:
    """What a directory entry is; the order of the tests matters."""
    low = F.lower(name)
    return F.when(name.startswith("._"), "sidecar").when(low.endswith(".part"), "leftover").when(low.endswith(extension), "check").otherwise("other")


#: Problem categories, those of damaged content first.
INTEGRITY_PROBLEMS = ("too_small", "invalid_structure", "unreadable", "leftover")
OTHER_PROBLEMS = ("sidecar", "other")


def is_integrity_failure(category: Column) -> Column:
    return category.isin(*INTEGRITY_PROBLEMS)
