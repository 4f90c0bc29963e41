"""HTML pages as Markdown and as sections: a small helper of Arrow batches, since no built-in function reads tag soup."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import by_row

SKIPPED = ("script", "style", "nav", "footer", "head", "noscript", "template")
BLOCKS = ("p", "div", "section", "article", "ul", "ol", "blockquote", "figure", "body", "main")
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
SECTION = "struct<level:int,title:string,text:string>"


def table_grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """WN12: rows of cells (text, rowspan, colspan) on a grid: a text stands at its first place, the other places it covers are empty."""
    taken: set[tuple[int, int]] = set()
    grid = []
    for r, cells in enumerate(rows):
        line: dict[int, str] = {}
        c = 0
        for text, down, right in cells:
            while (r, c) in taken:
                c += 1
            line[c] = text
            taken |= {(r + i, c + j) for i in range(down) for j in range(right)}
            c += right
        width = max((j + 1 for i, j in taken if i == r), default=0)
        grid.append([line.get(j, "") for j in range(width)])
    return grid


class _Reader(HTMLParser):
    """Gathers blocks, one string each; inline text runs into the open block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.title, self.in_title = "", False
        self.run, self.prefix, self.skip, self.pre = "", "", 0, False
        self.links: list[str] = []
        self.rows: list[list[list]] | None = None

    def close_block(self) -> None:
        text = self.run.strip("\n") if self.pre else re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*", "\n", re.sub(r"[ \t\r\f\v]+", " ", self.run)).strip()
        text = re.sub(r"\*\*\s*\*\*|``", "", text) if not self.pre else text
        if text:
            self.blocks.append(f"```\n{text}\n```" if self.pre else self.prefix + text)
        self.run, self.prefix = "", ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if self.rows is not None and tag in ("tr", "td", "th"):
            if tag == "tr":
                self.rows.append([])
            elif self.rows:
                span = lambda n: max(1, min(int(a.get(n) or 1), 1000)) if str(a.get(n) or 1).isdigit() else 1
                self.rows[-1].append(["", span("rowspan"), span("colspan")])
        elif tag == "table":
            self.close_block()
            self.rows = []
        elif re.fullmatch("h[1-6]", tag):
            self.close_block()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.close_block()
            self.prefix = "- "
        elif tag == "pre":
            self.close_block()
            self.pre = True
        elif tag in BLOCKS:
            self.close_block()
        elif tag == "br":
            self.add("\n")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.add("[")
        elif tag in MARKS and not self.pre:
            self.add(MARKS[tag])

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in SKIPPED and self.skip:
            self.skip -= 1
            return
        if self.skip:
            return
        if tag == "table" and self.rows is not None:
            grid = table_grid([[(re.sub(r"\s+", " ", t).strip().replace("|", "\\|"), d, r) for t, d, r in row] for row in self.rows if row])
            width = max(map(len, grid), default=0)
            lines = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in grid]
            self.rows = None
            if lines:
                self.blocks.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        elif re.fullmatch("h[1-6]", tag) or tag in ("li", "pre") or tag in BLOCKS:
            self.close_block()
            self.pre = False
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.add(f"]({href})")
        elif tag in MARKS and not self.pre:
            self.add(MARKS[tag])

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.add(data if self.pre else re.sub(r"\s+", " ", data))

    def add(self, text: str) -> None:
        if self.rows:
            if self.rows[-1]:
                self.rows[-1][-1][0] += text
        elif self.rows is None:
            self.run += text


def read(html: str | None) -> tuple[str, list[str]]:
    """The title and the Markdown blocks of a page; unclosed tags end with their parents."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.close_block()
    return re.sub(r"\s+", " ", reader.title).strip(), reader.blocks


def sections(blocks: list[str]) -> list[dict]:
    """Level, title and text below each heading; what comes before the first has level 0 and no title."""
    out = [{"level": 0, "title": "", "text": []}]
    for b in blocks:
        if m := re.match(r"(#{1,6}) (.*)", b):
            out.append({"level": len(m[1]), "title": m[2], "text": []})
        else:
            out[-1]["text"].append(b)
    return [s | {"text": "\n\n".join(s["text"])} for s in out if s["level"] or s["text"]]


def html_to_markdown(html: Column) -> Column:
    """DC2: a page as Markdown: headings, paragraphs, lists, tables, links, emphasis and code; navigation, scripts and styles go."""
    return by_row(lambda x: None if x is None else "\n\n".join(read(x)[1]), "string")(html)


def html_sections(html: Column) -> Column:
    """DC1: the title of a page and its sections in order; null for a null page."""

    def of(x: str | None) -> tuple:
        if x is None:
            return None, None
        title, blocks = read(x)
        return title, sections(blocks)

    return by_row(of, f"struct<title:string,sections:array<{SECTION}>>")(html)
