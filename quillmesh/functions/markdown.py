"""Sections of Markdown texts as column expressions over whole texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import let, squeeze

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
# Titles of the list of references.
REFERENCE_TITLES = ("references", "bibliography", "reference")


def lines(markdown: Column) -> Column:
    return F.split(F.coalesce(markdown, F.lit("")), "\n")


def heading_level(line: Column) -> Column:
    """The level of a heading, 0 for other lines."""
    return F.char_length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column) -> Column:
    return squeeze(F.regexp_extract(line, HEADING, 2))


def _reference_title(line: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(heading_title(line)), "[.:]+$", ""), r"^[0-9ivx.\s]+", "")
    return (heading_level(line) > 0) & plain.isin(*REFERENCE_TITLES)


def strip_references(markdown: Column) -> Column:
    """ST16: the text without its first section of references; what follows at the same or a higher level stays."""

    def cut(all_: Column) -> Column:
        start = F.array_min(F.transform(all_, lambda x, i: F.when(_reference_title(x), i)))

        def without(s: Column) -> Column:
            level = heading_level(F.get(all_, s))
            ends = F.array_min(F.transform(all_, lambda x, i: F.when((i > s) & heading_level(x).between(1, level), i)))
            rest = let(ends, lambda e: F.when(e.isNull(), F.array().cast("array<string>")).otherwise(F.slice(all_, e + 1, F.size(all_))))
            return F.array_join(F.concat(F.slice(all_, F.lit(1), s), rest), "\n")

        return F.coalesce(let(start, lambda s: F.when(s.isNotNull(), without(s))), markdown)

    return let(lines(markdown), cut)


def section_outline(markdown: Column) -> Column:
    """ST23: (level, title, line) of the headings before the references, lines counted from 1."""

    def of(all_: Column) -> Column:
        heads = F.filter(F.transform(all_, lambda x, i: F.struct(heading_level(x).alias("level"), heading_title(x).alias("title"), (i + 1).alias("line"))), lambda h: h["level"] > 0)
        end = F.array_min(F.transform(F.filter(heads, lambda h: F.lower(h["title"]).isin(*REFERENCE_TITLES)), lambda h: h["line"]))
        return let(end, lambda e: F.filter(heads, lambda h: e.isNull() | (h["line"] < e)))

    return let(lines(markdown), of)


def first_heading(markdown: Column) -> Column:
    """ST23: the title of the first heading of level 1, empty without one."""
    first = F.get(F.filter(lines(markdown), lambda x: x.rlike(r"^#\s+\S")), 0)
    return F.coalesce(squeeze(F.regexp_extract(first, r"^#\s+(.+?)\s*$", 1)), F.lit(""))


def section_text(markdown: Column, title: str) -> Column:
    """ST23: the text below the first heading of that title, to the next heading of any level, white space squeezed."""
    body = F.regexp_extract(F.coalesce(markdown, F.lit("")), rf"(?is)(?:^|\n)#+[ \t]*{title}[ \t]*(?:\n(.*)|$)", 1)
    return squeeze(F.element_at(F.split(F.concat(F.lit("\n"), body), r"\n#+\s+", 2), 1))


def year_of(paper_id: Column) -> Column:
    """ST24: the year that an id begins with, or unknown."""
    year = F.regexp_extract(paper_id, r"^((?:19|20)\d{2})", 1)
    return F.when(year == "", "unknown").otherwise(year)


def venue_of(paper_id: Column) -> Column:
    """ST24: venue and year of an id such as 2025.acl-long.12, else empty."""
    parts = F.split(paper_id, r"\.")
    return F.when((F.size(parts) >= 2) & F.get(parts, 0).rlike(r"^(?:19|20)\d{2}$"), F.concat_ws(" ", F.upper(F.get(parts, 1)), F.get(parts, 0))).otherwise("")


def _folded():
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c.isalnum()))

    return run


def folded_title(title: Column) -> Column:
    """ST4: NFKC, case folded, letters and digits alone; ASCII texts stay in the engine."""
    other = F.when(F.octet_length(title) != F.char_length(title), title)
    return F.coalesce(_folded()(other), F.regexp_replace(F.lower(title), "[^a-z0-9]", ""))
