"""Figures with their pictures: where they are looked for, what is missing, and broken sources."""

from __future__ import annotations

from quillmesh.operators import figures, packages

MAIN = r"""\documentclass{x}\graphicspath{{./img/}{more}}\begin{document}
\begin{figure}\includegraphics[width=\textwidth]{a}\caption[short]{Plot of \emph{A}}\label{fig:a_1}\end{figure}
% \begin{figure}\includegraphics{hidden}\end{figure}
\begin{figure*}\includegraphics{./b.png}\includegraphics*{sub/c}\begin{overpic}[x]{d.eps}\end{overpic}\caption{Two}\end{figure*}
\input{parts/body}
\begin{figure}\caption{After}\includegraphics{after}\end{figure}
\begin{figure}\includegraphics{never ends}"""
BODY = r"\begin{figure}\caption{None \% here}\label{}\end{figure}\begin{figure}\includegraphics{near}\includegraphics{lone}\includegraphics{twice}\includegraphics{none.pdf}\end{figure}"
FILES = ["main.tex", "parts/body.tex", "img/a.png", "more/a.pdf", "b.png", "more/sub/c.jpg", "img/d.eps", "parts/near.svg", "deep/near.pdf", "deep/lone.pdf", "x/twice.pdf", "y/twice.png", "deep/.hidden"]


def found(spark, packs):
    rows = [(p, n, {"main.tex": m, "parts/body.tex": b}.get(n)) for p, m, b, names in packs for n in names]
    files = spark.createDataFrame(rows, "package string, name string, content string")
    return figures.figure_files(packages.assembled(files), files)


def test_pictures_are_looked_for_in_order(spark):
    got = found(spark, [("p", MAIN, BODY, FILES)])
    rows = {(r.n, r.k): r for r in got.collect()}
    s = {k: (r.figure_id, r.role, r.status, r.path, r.output) for k, r in rows.items()}
    assert s[1, 1] == ("fig::fig-a-1", "primary", "copied", "img/a.png", "figures/fig_001_fig-a-1.png")
    assert s[2, 1] == ("fig::figure-2", "primary", "copied", "b.png", "figures/fig_002_figure-2.png")
    assert s[2, 2] == ("fig::figure-2", "subfigure", "copied", "more/sub/c.jpg", "figures/fig_002_figure-2.jpg")
    assert s[2, 3] == ("fig::figure-2", "subfigure", "copied", "img/d.eps", "figures/fig_002_figure-2.eps")
    assert s[3, 1] == ("fig::figure-3", "unknown", "missing", "", "")
    assert s[4, 1][3] == "parts/near.svg" and s[4, 2][3] == "deep/lone.pdf"
    assert s[4, 3][1:] == ("subfigure", "missing", "twice", "") and s[4, 4][1:] == ("subfigure", "missing", "none.pdf", "")
    assert s[5, 1][1:] == ("primary", "missing", "after", "") and len(s) == 10
    assert rows[1, 1].caption == "Plot of A" and rows[2, 1].environment == "figure*" and rows[3, 1].reason == "no picture in the figure" and rows[4, 4].reason == "no file for none.pdf"
    assert {r.file for r in rows.values() if r.n in (3, 4)} == {"parts/body.tex"} and rows[1, 1].file == "main.tex"
    assert [tuple(r) for r in figures.figure_totals(got).collect()] == [("p", 5, 6, 4)]


def test_other_packages_and_nothing_at_all(spark):
    names = ["main.tex", "a.png"]
    rows = found(spark, [("p", r"\begin{figure}\includegraphics{a}\end{figure}", "", ["main.tex"]), ("q", r"\begin{figure}\includegraphics{a}\end{figure}", "", names + names), ("r", None, "", names), (None, r"\begin{figure}\end{figure}", "", names)]).collect()
    assert sorted((r.package, r.path, r.status) for r in rows) == [("p", "a", "missing"), ("q", "a.png", "copied")]
