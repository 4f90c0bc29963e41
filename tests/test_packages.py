"""Golden and awkward cases of TeX packages, content lists, chosen references and merged texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as t
from quillmesh.operators import packages


def test_inputs_come_in_once_and_circles_end():
    files = {"main.tex": r"a \input{s/b} \input{none} \include{c.tex}", "s/b.tex": r"b\input{d}\input{main}", "s/d.tex": "d", "d.tex": "top", "c.tex": ""}
    text, names = packages.inlined("main.tex", files)
    assert names == ["s/b.tex", "s/d.tex", "main.tex", "c.tex"]
    assert text == "a \n% BEGIN included from s/b.tex\nb\n% BEGIN included from s/d.tex\nd\n% END included from s/d.tex\n\n% BEGIN included from main.tex\n\n% END included from main.tex\n\n% END included from s/b.tex\n \\input{none} \n% BEGIN included from c.tex\n\n% END included from c.tex\n"
    deep = {f"f{i}.tex": rf"\input{{f{i + 1}}}" for i in range(5000)}
    assert len(packages.inlined("f0.tex", deep)[1]) == 4999


def test_main_file_by_score(spark):
    rows = [("p", "supp.tex", r"\documentclass \title"), ("p", "x/paper.tex", r"\documentclass"), ("p", "notes.md", ""), ("q", "b.tex", None), ("q", "a.tex", ""), ("r", "a.bib", "x"), (None, "a.tex", "")]
    got = packages.assembled(spark.createDataFrame(rows, "package string, name string, content string"))
    assert sorted((r.package or "", r.main, r.source) for r in got.collect()) == [("", "a.tex", ""), ("p", "x/paper.tex", r"\documentclass"), ("q", "a.tex", "")]


def test_records_of_packages_without_references_or_metadata(spark):
    files = spark.createDataFrame([(1, "a.tex", r"\title{T} \cite{k,k}"), (2, "a.tex", ""), (2, "a.bib", None)], "package int, name string, content string")
    known = spark.createDataFrame([], "package int, arxiv_id string, title string, authors array<string>, year string, abstract string")
    got = sorted(packages.parsed_packages(files, known).collect())
    assert [(r.package, r.paper_id, r.metadata.title, r.metadata.year, r.n_references, r.n_citations, r.cites) for r in got] == [(1, "paper::", "T", "unknown", 0, 2, []), (2, "paper::", "", "unknown", 0, 0, [])]


def test_content_lists_of_both_shapes_and_bad_ones(spark):
    rows = [(1, '[{"type":"text","text":"x"},null,{"type":"list","list_items":["a"]}]', 0), (2, '[[],[{"type":"text","text":"y"}]]', 0), (3, "[]", 0), (4, "{", 0), (5, None, 0), (6, "", 0), (7, '[[{"text":"z","page_idx":9}],[]]', 0)]
    got = packages.content_blocks(spark.createDataFrame(rows, "doc int, content string, text_ int"))
    assert sorted((r.doc, r.text or "", r.page_idx) for r in got.collect()) == [(1, "", None), (1, "x", None), (2, "y", 1), (7, "z", 9)]


def test_chosen_references_of_missing_files(spark):
    rows = [(1, None, None), (2, [], ["a"]), (3, ["a"], None), (4, ["a"] * 6, ["b"] * 12), (5, ["a"] * 7, ["b"] * 12)]
    got = packages.chosen_references(spark.createDataFrame(rows, "paper int, listed array<string>, marked array<string>"))
    assert [(r.source, len(r.chosen), list(r.warnings)) for r in got.orderBy("paper").collect()] == [
        ("content_list", 0, ["missing content list", "missing Markdown", "no references"]),
        ("markdown_fallback", 1, []),
        ("content_list", 1, ["missing Markdown"]),
        ("content_list", 6, ["content list has 6 candidates, Markdown 12"]),
        ("content_list", 7, []),
    ]


def test_merged_texts_begin_with_a_continuation(spark):
    rows = [(1, 0, "a", True), (1, 1, None, True), (1, 2, "b", None), (1, 3, "c", True), (1, 4, "中", True), (None, 0, "x", False)]
    got = packages.merged_texts(spark.createDataFrame(rows, "doc int, idx int, text string, merge_prev boolean"))
    assert sorted((r.doc or 0, r.first_idx, r.text) for r in got.collect()) == [(0, 0, "x"), (1, 0, "a"), (1, 2, "b c中")]


def test_flat_boxes_and_ids(spark):
    flat, box = tuple(F.lit(float(x)) for x in (1, 1, 1, 1)), tuple(F.lit(float(x)) for x in (0, 0, 4, 5))
    row = spark.range(1).select(t.box_gap(flat, box), t.relative_box(box, flat), t.box_gap(box, tuple(F.lit(float(x)) for x in (7, 9, 8, 10))), t.anthology_id(F.lit("P19"), F.lit("1"), F.lit("1234")), t.resource_id(F.lit("k"), F.lit(""))).first()
    assert tuple(row) == (0.0, [0.0, 0.0, 1.0, 1.0], 5.0, "P19-11234", "k::unknown")
