"""Citations in running text, with their places."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import by_row

# The shapes of citations.
NAME = r"[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’.-]+"
YEAR = r"(?:19|20)\d{2}[a-z]?"
_PAREN = re.compile(rf"\(([^()\n]{{0,700}}{YEAR}[^()\n]{{0,700}})\)")
_TEXTUAL = re.compile(rf"\b({NAME}(?:\s+(?:et\s+al\.|and\s+{NAME}))?)\s*\(({YEAR}(?:\s*[,;/]\s*(?:19|20)?\d{{0,4}}[a-z]?|\s*(?:and|&)\s*{YEAR})*)\)")
_NUMERIC = re.compile(r"(?<!!)\[(\d+(?:\s*[,–-]\s*\d+)*)\]")
_AUTHOR_YEAR = re.compile(rf"\b({NAME})(?:\s+et\s+al\.)?(?:\s+and\s+{NAME})?\s*,?\s*({YEAR})")
_YEAR = re.compile(rf"\b{YEAR}\b")


def authors_and_years(inner: str) -> list[tuple[str, str]]:
    """(author, year) of the inside of a parenthesis; years without a name belong to the last one, across semicolons."""
    found, author = [], ""
    for part in inner.split(";"):
        end = 0
        for m in _AUTHOR_YEAR.finditer(part):
            author, end = m[1], m.end()
            found.append((author, m[2]))
        found += [(author, y[0]) for y in _YEAR.finditer(part, end) if author]
    return found


def scan(text: str) -> list[dict]:
    """All citations by start: textual, parenthetical outside these, and numeric."""
    row = lambda kind, m, cited: {"kind": kind, "start": m.start(), "end": m.end(), "raw": m[0], "cited": [{"author": a, "year": y} for a, y in cited]}
    found = [row("textual", m, [(m[1], y[0]) for y in _YEAR.finditer(m[2])]) for m in _TEXTUAL.finditer(text)]
    taken, at = [(f["start"], f["end"]) for f in found], 0
    for m in _PAREN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or taken[at][0] >= m.end():
            found.append(row("parenthetical", m, authors_and_years(m[1])))
    found += [row("numeric", m, []) for m in _NUMERIC.finditer(text)]
    found.sort(key=lambda f: (f["start"], f["end"]))
    line, at = 1, 0
    for f in found:
        line += text.count("\n", at, f["start"])
        at, f["line"] = f["start"], line
    return found


def citations(c: Column) -> Column:
    """ST14: array of (kind, start, end, line, raw, cited) with cited an array of (author, year); places count from 0, lines from 1, null texts have none."""
    run = by_row(scan, "array<struct<kind:string, start:int, end:int, line:int, raw:string, cited:array<struct<author:string, year:string>>>>")
    return run(F.coalesce(c, F.lit("")))
