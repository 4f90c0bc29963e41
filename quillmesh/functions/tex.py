"""TeX sources and bibliographies: one tokenizer and one tree of groups, from which texts, arguments, entries and items are read.

A source is read once into nodes: pieces of text, commands, escaped characters and groups in braces. Everything else walks
this tree. Trees are built and walked with stacks of their own, so depth does not matter; columns are read in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import by_row

# Commands and environments that count.
CITES = ("cite", "Cite", "citep", "Citet", "Citep", "citet", "citealt", "citealp", "citeauthor", "parencite", "textcite")
GRAPHICS = ("includegraphics",)
LEVELS = ("section", "subsection", "subsubsection")
# Commands whose last argument is text, with how many arguments they take, and those that part names.
STYLED = {"url": 1, "texttt": 1, "textbf": 1, "emph": 1, "textit": 1, "textcolor": 2}
PARTING = ("And", "AND", "and", "quad")
NOT_NAMES = ("affiliation", "email")
# Words with which the name of an author ends and an affiliation begins.
AFFILIATIONS = ("University", "Institute", "College", "School", "Department", "Laboratory", "Inc", "Group", "Hong", "Kong", "Guangzhou", "Tsinghua", "Nanyang", "Renmin", "China", "Beijing")

_TOKEN = re.compile(r"\\(?P<command>[A-Za-z]+\*?)|\\(?P<escaped>.)|(?P<open>\{)|(?P<close>\})|(?P<text>[^\\{}]+|\\)", re.DOTALL)
_ARXIV = re.compile(r"\b(\d{4}\.\d{4,5})(?:v\d+)?\b")
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_WORD = re.compile(r"[\w-]+\s*\Z")


@dataclass(slots=True)
class Node:
    """A piece of a source: kind is text, command, escaped or group; value is its text, or the command's name."""

    kind: str
    value: str
    start: int
    end: int
    inner: list[Node] = field(default_factory=list)
    closed: bool = True


def tree(text: str) -> list[Node]:
    """The nodes of a source. A brace without partner closes nothing, an open group runs to the end and is not closed."""
    top: list[Node] = []
    open_, level = [], top
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            group = Node("group", "", m.start(), len(text), closed=False)
            level.append(group)
            open_.append((group, level))
            level = group.inner
        elif kind == "close":
            if open_:
                group, level = open_.pop()
                group.end, group.closed = m.end(), True
        else:
            level.append(Node(kind, m[kind], m.start(), m.end()))
    return top


def _arguments(nodes: list[Node], at: int, most: int) -> tuple[list[Node], int]:
    """Up to `most` groups after the command at `at`, past one optional argument and blanks, and the place after the last."""
    found: list[Node] = []
    k, inside = at + 1, False
    after = k
    while k < len(nodes) and len(found) < most:
        n = nodes[k]
        if n.kind == "text":
            rest = n.value.lstrip()
            if not found and (inside or rest.startswith("[")):
                _, mark, rest = (n.value if inside else rest).partition("]")
                inside = not mark
            if not inside and rest.strip():
                break
        elif n.kind == "group":
            if not inside:
                found.append(n)
                after = k + 1
        elif not inside:
            break
        k += 1
    return found, after


def walk(nodes: list[Node]) -> Iterator[tuple[list[Node], int]]:
    """(siblings, place) of every node, in the order of the source."""
    work = [(nodes, 0)]
    while work:
        level, at = work.pop()
        if at < len(level):
            yield level, at
            work.append((level, at + 1))
            if level[at].kind == "group":
                work.append((level[at].inner, 0))


def uses(nodes: list[Node], *names: str) -> Iterator[tuple[Node, Node]]:
    """(command, first argument) of each use of the named commands whose braces close; a star makes no difference."""
    for level, at in walk(nodes):
        n = level[at]
        if n.kind == "command" and n.value.rstrip("*") in names:
            found, _ = _arguments(level, at, 1)
            if found and found[0].closed:
                yield n, found[0]


def words_of(nodes: list[Node]) -> str:
    """Nodes as text: links and styled words stay, mathematics loses its dollars, other commands and all braces go."""
    out: list[str] = []
    work: list = [(nodes, 0)]
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        level, at = item
        if at >= len(level):
            continue
        n, after, then = level[at], at + 1, []
        if n.kind == "text":
            out.append(n.value.replace("$", "").replace("~", " "))
        elif n.kind == "group":
            then = [(n.inner, 0)]
        else:
            want = 2 if n.value == "href" else STYLED.get(n.value, 0) if n.kind == "command" else 0
            args, end = _arguments(level, at, want) if want else ([], after)
            if want and len(args) == want:
                after = end
                then = [(args[1].inner, 0), " (", (args[0].inner, 0), ")"] if n.value == "href" else [(args[-1].inner, 0)]
            else:
                out.append(" ")
                option = level[after].value if n.kind == "command" and after < len(level) and level[after].kind == "text" else ""
                if option.startswith("[") and "]" in option:
                    out.append(option.partition("]")[2].replace("$", "").replace("~", " "))
                    after += 1
        work.append((level, after))
        work.extend(reversed(then))
    return " ".join("".join(out).split())


def plain(text: str) -> str:
    """ST27: TeX as text."""
    return words_of(tree(text))


def braced(text: str, at: int) -> tuple[str, int] | None:
    """What the brace at `at` encloses, and the place after its partner; None if there is no partner."""
    group = tree(text[at:])[0]
    return (text[at + 1 : at + group.end - 1], at + group.end) if group.closed else None


def without_comments(c: Column, kept: str = "") -> Column:
    """ST27: each line up to its first % that no backslash escapes; lines end at \\n. Comments that begin with the pattern `kept` stay."""
    return F.regexp_replace(c, r"(^|[^\\])((?:\\\\)*)%" + (f"(?!{kept})" if kept else "") + r"[^\n]*", "$1$2")


def _first(nodes: list[Node], command: str) -> str:
    return next((words_of(a.inner) for _, a in uses(nodes, command)), "")


def _name(nodes: list[Node]) -> str:
    """A part of \\author as a name: without addresses and marks, up to the first word of an affiliation."""
    kept = []
    for word in re.sub(r"\[[^\]]+\]", " ", words_of(nodes)).split():
        if re.match(rf"\W*(?:{'|'.join(AFFILIATIONS)})\b", word):
            break
        if not re.fullmatch(r"\S+@\S+", word):
            kept.append(word)
    return " ".join(kept)


def _name_parts(nodes: list[Node]) -> Iterator[list[Node]]:
    """The runs of nodes between commas, line ends and parting commands; formulas and the commands of NOT_NAMES fall out."""
    part: list[Node] = []
    at, formula = 0, False
    while at < len(nodes):
        n = nodes[at]
        at += 1
        if n.kind == "command" and n.value in NOT_NAMES:
            at = _arguments(nodes, at - 1, 1)[1]
        elif (n.kind == "command" and n.value in PARTING) or (n.kind == "escaped" and n.value == "\\"):
            yield part
            part = []
        elif n.kind == "text":
            for piece in re.split(r"([$,])", n.value):
                if piece == "$":
                    formula = not formula
                elif formula:
                    continue
                elif piece == ",":
                    yield part
                    part = []
                else:
                    part.append(Node("text", piece, n.start, n.end))
        elif not formula:
            part.append(n)
    yield part


def author_names(nodes: list[Node]) -> list[str]:
    """Names of two words or more out of \\author: bold ones if there are any, otherwise what stands between separators."""
    found: dict[str, None] = {}
    for _, argument in uses(nodes, "author"):
        bold = [a.inner for _, a in uses(argument.inner, "textbf") if a.inner]
        for part in bold or _name_parts(argument.inner):
            name = _name(part)
            if " " in name and len(name) < 80:
                found[name] = None
    return list(found)


def _sentence(text: str, stops: list[int], start: int, end: int) -> str:
    """The text around a span: from the last end of a sentence, clause or paragraph before it to the first after it."""
    before, after = bisect_right(stops, start - 2), bisect_left(stops, end)
    left = stops[before - 1] + 1 if before else 0
    right = stops[after] + 1 if after < len(stops) else end + 240
    return plain(text[left:right])


_FIGURE = re.compile(r"\\begin\{(figure\*?)\}")
_BEGIN = re.compile(r"\\begin\{(abstract|figure\*?|table\*?)\}")
_CITE = re.compile(rf"\\({'|'.join(CITES)})(?:\s*\[[^\]]*\]){{0,2}}\s*\{{([^{{}}]+)\}}")


def _environments(text: str, begin: re.Pattern[str] = _BEGIN) -> Iterator[tuple[str, int, str]]:
    """(name, start, body) of abstracts and floats that end, those inside another one left out."""
    at = 0
    while (m := begin.search(text, at)) is not None:
        end = text.find(f"\\end{{{m[1]}}}", m.end())
        at = m.end() if end < 0 else end
        if end >= 0:
            yield m[1], m.start(), text[m.end() : end]


def structure(text: str) -> dict:
    """ST29: title, authors, abstract, sections, floats and citations of a source without comments."""
    nodes = tree(text)
    heads = [(c.start, c.value.rstrip("*"), words_of(a.inner)) for c, a in uses(nodes, *LEVELS)]
    bodies = [(name.rstrip("*"), body, tree(body)) for name, _, body in _environments(text)]
    floats = [{"kind": name, "label": next((body[a.start + 1 : a.end - 1] for _, a in uses(inside, "label") if a.inner), ""), "caption": _first(inside, "caption")} for name, body, inside in bodies if name != "abstract"]
    stops = [m.start() for m in re.finditer(r"(?=\. |\n\n|; )", text)]
    starts = [h[0] for h in heads]
    cites = []
    for n, m in enumerate(_CITE.finditer(text), 1):
        head = bisect_left(starts, m.start())
        place = {"n": n, "command": m[1], "section": heads[head - 1][2] if head else "", "context": _sentence(text, stops, m.start(), m.end())}
        cites += [{**place, "key": key.strip()} for key in m[2].split(",") if key.strip()]
    titles = [t.lower() for _, _, t in heads]
    return {
        "title": _first(nodes, "title"),
        "authors": author_names(nodes),
        "abstract": next((words_of(inside) for name, _, inside in bodies if name == "abstract"), ""),
        "sections": [{"level": level, "title": t} for _, level, t in heads if t],
        "floats": floats,
        "cites": cites,
        "has_appendix": "\\appendix" in text or any("appendix" in t for t in titles),
        "has_supplement": any("supplement" in t for t in titles),
    }


STRUCTURE = "title string, authors array<string>, abstract string, sections array<struct<level:string, title:string>>, floats array<struct<kind:string, label:string, caption:string>>, cites array<struct<n:int, command:string, section:string, context:string, key:string>>, has_appendix boolean, has_supplement boolean"


def tex_structure(c: Column) -> Column:
    """ST29: the structure of a TeX source as a struct; null texts are empty sources."""
    return by_row(structure, STRUCTURE)(F.coalesce(without_comments(c), F.lit("")))


def _pictures(nodes: list[Node], text: str) -> Iterator[str]:
    """The paths of included graphics and of pictures that are drawn over, in order."""
    for level, at in walk(nodes):
        n = level[at]
        if n.kind != "command" or n.value.rstrip("*") not in (*GRAPHICS, "begin"):
            continue
        found, after = _arguments(level, at, 1)
        if n.value == "begin":
            over = bool(found) and text[found[0].start + 1 : found[0].end - 1] == "overpic"
            found, _ = _arguments(level, after - 1, 1) if over else ([], 0)
        if found and found[0].closed and (path := text[found[0].start + 1 : found[0].end - 1].strip()):
            yield path


def figures(text: str) -> dict:
    """ST38: the figures of a source, with the file that each stands in ('' for the main one), and the folders of its pictures."""
    nodes = tree(text)
    folders = [text[g.start + 1 : g.end - 1].strip() for _, a in uses(nodes, "graphicspath") for g in a.inner if g.kind == "group" and g.closed]
    marks = [(m.start(), m[1].strip()) for m in re.finditer(r"% BEGIN included from ([^\n]+)", text)]
    places = [m[0] for m in marks]
    found = []
    for n, (name, start, body) in enumerate(_environments(text, _FIGURE), 1):
        inside = tree(body)
        label = next((body[a.start + 1 : a.end - 1] for _, a in uses(inside, "label") if a.inner), "")
        before = bisect_right(places, start)
        found.append({"n": n, "environment": name, "label": label, "label_text": plain(label), "caption": _first(inside, "caption"), "file": marks[before - 1][1] if before else "", "pictures": list(_pictures(inside, body))})
    return {"folders": [f for f in folders if f], "figures": found}


FIGURES = "folders array<string>, figures array<struct<n:int, environment:string, label:string, label_text:string, caption:string, file:string, pictures:array<string>>>"


def tex_figures(c: Column) -> Column:
    """ST38: the figures of a TeX source put together from its files, as a struct; null texts have none."""
    return by_row(figures, FIGURES)(F.coalesce(without_comments(c, r" (?:BEGIN|END) included from "), F.lit("")))


def plain_tex(c: Column) -> Column:
    """ST27: TeX as plain text; null stays null."""
    return by_row(lambda x: None if x is None else plain(x), "string")(c)


def _fields(body: str) -> Iterator[tuple[str, int, int, str]]:
    """(name, start, end, value) of the fields of an entry's body, in one pass; a value is a group, a quoted text or a bare word."""
    at = 0
    while (eq := body.find("=", at)) >= 0:
        name = _WORD.search(body, at, eq)
        at = eq + 1
        while at < len(body) and body[at].isspace():
            at += 1
        mark = body[at : at + 1]
        if mark == "{":
            inner = braced(body, at)
            value, end = inner or (body[at + 1 :], len(body))
        elif mark == '"':
            quote = next((m.end() for m in _TOKEN_QUOTE.finditer(body, at + 1) if m[0] == '"'), 0)
            value, end = (body[at + 1 : quote - 1], quote) if quote else (body[at + 1 :], len(body))
        else:
            end = min((k for k in (body.find(",", at), body.find("}", at)) if k >= 0), default=len(body))
            value = body[at:end]
        if name:
            yield name[0].strip().lower(), name.start(), end, value if mark in ("{", '"') else ""
        at = end


_TOKEN_QUOTE = re.compile(r'\\.|"', re.DOTALL)


def _entry(key: str, kind: str, fields: dict[str, str]) -> dict:
    number = _ARXIV.search(" ".join(fields.values()))
    either = lambda *names: next(filter(None, map(fields.get, names)), "")
    return {"key": key.strip(), "type": kind, "title": either("title"), "authors": either("author"), "year": either("year"), "venue": either("journal", "booktitle"), "doi": either("doi"), "arxiv_id": number[1] if number else ""}


def bib_entries(text: str) -> list[dict]:
    """ST28: the entries of a .bib file in order: groups after @ and a word, with a key before the first comma."""
    nodes, found = tree(text), []
    for before, group in zip(nodes, nodes[1:]):
        kind = re.search(r"@(\w+)\s*\Z", before.value) if before.kind == "text" and group.kind == "group" else None
        key = re.match(r"\s*([^,{}]+),", text[group.start + 1 : group.end]) if kind else None
        if key:
            body = text[group.start + 1 + key.end() : group.end - 1 if group.closed else group.end]
            found.append(_entry(key[1], kind[1].lower(), {name: plain(value) for name, _, _, value in _fields(body)}))
    return found


def bbl_entries(text: str) -> list[dict]:
    """ST28: the items of a .bbl file in order: authors up to the first full stop, then the title."""
    found, nodes = [], tree(text)
    starts = [(c.start, a) for c, a in uses(nodes, "bibitem") if a.inner]
    last = text.find("\\end{thebibliography}", starts[-1][0]) if starts else -1
    ends = [start for start, _ in starts[1:]] + [last]
    for (_, key), end in zip(starts, ends, strict=True):
        if end < 0:
            continue
        body = plain(text[key.end : end])
        said = [p for p in map(str.strip, body.split(".")) if p][:2]
        authors, title = (*said, "", "")[:2]
        year = _YEAR.search(body)
        found.append({**_entry(text[key.start + 1 : key.end - 1], "unknown", {"all": body}), "title": title, "authors": authors, "year": year[0] if year else ""})
    return found


ENTRIES = "array<struct<key:string, type:string, title:string, authors:string, year:string, venue:string, doi:string, arxiv_id:string>>"


def references(name: Column, content: Column) -> Column:
    """ST28: the entries of a file, read as .bbl or .bib by its name; null content has none."""
    read = lambda n, x: (bbl_entries if n.endswith(".bbl") else bib_entries)(x)
    return by_row(read, ENTRIES)(F.coalesce(name, F.lit("")), F.coalesce(content, F.lit("")))


def stripped(text: str, field: str = "note") -> str:
    """A .bib text without the fields of one name, their values and the commas after these."""
    out, done = [], 0
    for start, end in _named(text, field):
        out.append(text[done:start])
        done = re.compile(r"[ \t]*,?").match(text, end).end()
    return "".join(out) + text[done:]


def _named(text: str, field: str) -> Iterator[tuple[int, int]]:
    """Where fields of a name begin and end, at any depth but not inside one of them."""
    done = 0
    for m in re.finditer(rf"(?i)(?<![\w-]){re.escape(field)}(?=\s*=)", text):
        if m.start() >= done:
            _, _, end, _ = next(_fields(text[m.start() :]))
            done = m.start() + end
            yield m.start(), done


def without_field(c: Column, field: str = "note") -> Column:
    """ST36: a .bib text without one field; null stays null."""
    return by_row(lambda x: None if x is None else stripped(x, field), "string")(c)


def bibtex(kind: Column, key: Column, fields: dict[str, Column]) -> Column:
    """ST30, SK3: one entry; fields that are null or empty stay out, braces in values are balanced by the caller."""
    lines = [F.when(v != "", F.concat(F.lit(f"  {n} = {{"), v, F.lit("}"))) for n, v in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), F.concat_ws(",\n", key, *lines), F.lit("\n}"))
