"""Golden and awkward cases of TeX sources, bibliographies, citations, reference lists, logs and supplements."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import citations as ct
from quillmesh.functions import tex
from quillmesh.operators import papers


def test_tex_text_golden_cases():
    assert tex.plain(r"\textcolor{red}{\textbf{A}} ~ $x_1$ \emph{b \texttt{c}} \foo[o]{d} \% {e}") == "A x_1 b c d e"
    assert tex.plain("") == "" and tex.plain("{" * 20_000) == ""
    assert tex.braced(r"{a {b} \} c} d", 0) == (r"a {b} \} c", 12) and tex.braced("{a", 0) is None


def test_tex_structure_golden_cases():
    s = r"""\title{T \emph{x}} \author[1]{Ann Lee, University of X, Bo \and Cy Wu$^1$ \email{c@d.e}}
\section*{One}\subsection[s]{Open {brace} First. We cite \cite{a, b} here; then. \section{Supplementary} \citet[1][2]{c}"""
    got = tex.structure(s)
    assert got["title"] == "T x" and got["authors"] == ["Ann Lee", "Cy Wu"] and got["has_supplement"] and not got["has_appendix"]
    assert got["sections"] == [{"level": "section", "title": "One"}, {"level": "section", "title": "Supplementary"}]
    assert [(c["n"], c["key"], c["section"]) for c in got["cites"]] == [(1, "a", "One"), (1, "b", "One"), (2, "c", "Supplementary")]
    assert got["cites"][0]["context"] == "We cite a, b here;" and tex.structure("")["cites"] == []


def test_bibliography_golden_cases():
    text = '@article{a, title = {One {Two}}, author="X \\"Y\\"", year=1999, journal = {}, booktitle={B}}\n@string{x} @book{a,title={Again}, note={arXiv:2001.00001v3}} @misc{open, title={never'
    assert [(e["key"], e["title"], e["venue"], e["arxiv_id"]) for e in tex.bib_entries(text)] == [("a", "One Two", "B", ""), ("a", "Again", "", "2001.00001")] + [("open", "never", "", "")]
    assert tex.bbl_entries(r"\bibitem[q]{k} Ann. A title. 2001. \bibitem{l}\end{thebibliography}") == [{"key": "k", "type": "unknown", "title": "A title", "authors": "Ann", "year": "2001", "venue": "", "doi": "", "arxiv_id": ""}, {"key": "l", "type": "unknown", "title": "", "authors": "", "year": "", "venue": "", "doi": "", "arxiv_id": ""}]
    assert tex.stripped("@a{k, note={a {b}}, x={notes}}\n% note") == "@a{k,  x={notes}}\n% note" and tex.stripped("note = {open") == ""


def test_packages_fall_back_and_take_the_last_key(spark):
    rows = [("p", "a.bib", "@x{k, title={1}} @x{k, title={2}}"), ("p", "b.bib", "@x{k, title={3}} @x{k, title={4}}"), ("p", "z.bbl", r"\bibitem{q} A. B.\end{thebibliography}"), ("q", "a.bib", "none"), ("q", "z.bbl", r"\bibitem{q} A. B.\end{thebibliography}"), ("r", "a.bib", None), (None, "a.bib", "@x{k, title={5}}")]
    got = papers.package_references(spark.createDataFrame(rows, "package string, name string, content string"))
    assert sorted((r.package or "", r.key, r.title, r.source) for r in got.collect()) == [("", "k", "5", "a.bib"), ("p", "k", "4", "a.bib"), ("q", "q", "B", "z.bbl")]


def test_citation_golden_cases(spark):
    found = ct.scan("Müller and Wu (2001a, 2002) say\n(see A. Lee et al., 1999; 2000; Kim 2010 and 2011) [1–3] ![4] [5, 6] (no year) (Lee (2003))")
    assert [(f["kind"], f["line"], [(a["author"], a["year"]) for a in f["cited"]]) for f in found] == [
        ("textual", 1, [("Müller and Wu", "2001a"), ("Müller and Wu", "2002")]),
        ("parenthetical", 2, [("Lee", "1999"), ("Lee", "2000"), ("Kim", "2010"), ("Kim", "2011")]),
        ("numeric", 2, []),
        ("numeric", 2, []),
        ("textual", 2, [("Lee", "2003")]),
    ]
    assert ct.scan("") == [] and len(ct.scan("(Lee, 2001) [1] " * 20_000)) == 40_000
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x [2]")], "paper int, text string")
    refs = spark.createDataFrame([(3, 2, "r", None, None)], "paper int, pos int, ref string, surname string, year string")
    assert [tuple(r) for r in papers.cited_references(rows, refs).select("paper", "kind", "year", "rung", "n_refs", "first_ref").collect()] == [(3, "numeric", "2", 1, 1, "r")]


def listed(lines):
    """A Markdown reference list, line by line."""
    year = re.compile(r"\b(?:18|19|20)\d{2}[a-z]?\b")
    entries, current, blank = [], "", True
    for line in (" ".join((x or "").split()) for x in lines):
        if line:
            whole = year.search(current) and re.search(r"[.!?。)]\s*$", current)
            start = re.match(r"[A-Z][a-z]+", line) and year.search(line)
            if current and start and (blank or whole):
                entries.append(current)
                current = line
            elif current:
                current = current[:-1] + line if re.search("[a-z]-$", current) and re.match("[a-z]", line) else f"{current} {line}"
            else:
                current = line
        blank = not line
    return entries + [current] if current else entries


def test_markdown_references_agree_with_a_loop(spark):
    kinds = ["", None, "Ann, B. 2001. One.", "Bo, C. 1999 open", "more of it.", "hy-", "phen 2003)", "Cy 2005 x."]
    lists = [[kinds[(i * 7 + j * (i + 3)) % 8] for j in range(i % 13)] for i in range(200)] + [[kinds[(i >> (3 * j)) % 8] for j in range(4)] for i in range(0, 4096, 7)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, lines array<string>")
    got = {r.i: r.e for r in df.select("i", papers.markdown_references(F.col("lines")).alias("e")).collect()}
    assert got == {i: listed(x) for i, x in enumerate(lists)}
    assert spark.range(1).select(papers.markdown_references(F.lit(None).cast("array<string>")).alias("e")).first().e == []


def test_wire_events_skip_bad_lines(spark):
    lines = ['{"type":"tool.call","time":"a","name":null,"args":[1]}', "", None, "[1]", "7", '{"type":"tool.result","result":{"stderr":"e"}}', '{"type":"tool.result","result":null}', '{"type":"context.append_loop_event"}']
    got = papers.wire_events(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, type_ int"))
    assert sorted((r.type_, r.type, r.name, r.args, r.output_chars, r.output_preview) for r in got.collect()) == [(0, "tool.call", None, "[1]", None, None), (5, "tool.result", None, None, 1, "e"), (6, "tool.result", None, None, 0, "")]


def test_supplements_report_or_raise(spark):
    df, bad = spark.range(2), [("bad", lambda d: True, lambda d: d.select("none"))]
    same, report = papers.supplemented(df, bad + [("no", lambda d: False, lambda d: d.limit(0))])
    assert same.count() == 2 and report[0]["error"] and report[1]["skipped"] and papers.supplemented(df, bad, "off") == (df, [])
    with pytest.raises(Exception, match="none"):
        papers.supplemented(df, bad, "required")


def test_only_left_is_cut_and_takes_nulls(spark):
    rows = spark.createDataFrame([(["a"] * 9, ["b"]), (None, ["b"]), (["a", "c"], None), ([], [])], "a array<string>, b array<string>")
    assert [r.v for r in rows.select(papers.only_left(F.col("a"), F.col("b")).alias("v")).collect()] == [["a"] * 5, [], ["a", "c"], []]
