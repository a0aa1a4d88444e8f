"""Seasons, links, file names and lenient parsing, as column expressions and driver helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_label(year: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), (year + 1).cast("string"))


def season_url(base: str, year: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), season_label(year), F.lit(suffix))


def flight_url(base: str, flight_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), flight_id.cast("string"))


def parse_seasons(value: str, first: int, last: int) -> list[int]:
    """``all``, a year, a range (either way round) or a comma list of these, as sorted distinct years; nothing is an error."""
    if value.strip().lower() == "all":
        return list(range(first, last + 1))
    years: set[int] = set()
    for part in filter(None, (p.strip() for p in value.split(","))):
        found = re.fullmatch(r"(\d{4})(?:\s*-\s*(\d{4}))?", part)
        if not found:
            raise ValueError(f"no season: {part!r}")
        a, b = int(found[1]), int(found[2] or found[1])
        years.update(range(min(a, b), max(a, b) + 1))
    if not years:
        raise ValueError("no seasons given")
    return sorted(years)


def sanitize_date(date: Column) -> Column:
    clean = F.regexp_replace(F.trim(F.coalesce(date, F.lit(""))), "[^0-9-]", "-")
    return F.when(clean == "", "0000-00-00").otherwise(clean)


def track_name(date: Column, flight_id: Column) -> Column:
    return F.concat(sanitize_date(date), F.lit("_"), flight_id.cast("string"), F.lit(".igc"))


def track_path(root: str, year: Column, date: Column, flight_id: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), season_label(year), F.lit("/"), track_name(date, flight_id))


def name_parts(name: Column) -> tuple[Column, Column]:
    """(date, flight_id) of a track name, split at its last underscore; both null for another name."""
    pattern = r"^(.*)_([^_]*)\.igc$"
    ok = F.regexp_like(name, F.lit(pattern))
    return F.when(ok, F.regexp_extract(name, pattern, 1)), F.when(ok, F.regexp_extract(name, pattern, 2))


def flight_of(name: Column) -> Column:
    """The flight's id in a track's file name; of a name that is not built from a date and an id, all before its extension."""
    return F.coalesce(name_parts(name)[1], F.regexp_replace(name, r"\.[^.]*$", ""))


def clean_link(link: Column, suffix: str = ".igc") -> Column:
    trimmed = F.trim(F.coalesce(link, F.lit("")))
    return F.when(F.lower(trimmed).endswith(suffix), trimmed).otherwise("")


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def lenient_double(text: Column) -> Column:
    """A decimal number, else null; the pattern keeps out suffixes such as 12.7d, which a cast takes."""
    return F.when(F.regexp_like(text, F.lit(_NUMBER)), F.trim(text).try_cast("double"))


def lenient_long(text: Column) -> Column:
    """Truncated toward zero; null for what is no finite number of that width."""
    value = lenient_double(text)
    cut = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return F.when(F.abs(value) < 9e18, cut.cast("bigint"))


def text_or_blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit(""))
