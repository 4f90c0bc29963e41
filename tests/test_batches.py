"""Readers of whole texts get a few rows at a time, however many a session's Arrow batches hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import citations, html_text, tex
from quillmesh.operators import packages as p

READERS = {
    "plain_tex": tex.plain_tex,
    "tex_structure": tex.tex_structure,
    "tex_figures": tex.tex_figures,
    "without_field": tex.without_field,
    "references": lambda c: tex.references(F.lit("a.bib"), c),
    "html_to_markdown": html_text.html_to_markdown,
    "html_sections": html_text.html_sections,
    "citations": citations.citations,
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", READERS)
def test_texts_are_read_in_small_batches(spark, name):
    found = plan(spark.createDataFrame([("x",)], "s string").select(READERS[name](F.col("s")).alias("v")))
    assert "BatchEvalPython" in found and "ArrowEvalPython" not in found


def test_packages_are_put_together_in_small_batches(spark):
    files = spark.createDataFrame([("p", "main.tex", "\\documentclass{x}")], "package string, name string, content string")
    found = plan(p.assembled(files))
    assert "BatchEvalPython" in found and "ArrowEvalPython" not in found
