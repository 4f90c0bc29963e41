"""Queries of figures and their pictures, with their SQL: a document is a package of a main file, a part and pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import figures as fg
from quillmesh.operators import packages as p
from quillmesh.plans.paper_queries import _spark
from quillmesh.session import table

# how many figures the main file has, and the pictures that are there for each of them
_FIGURE = "'\\begin{figure}\\includegraphics[w]{p' || i || '}\\caption{Fig \\emph{' || i || '}}' || CASE WHEN (doc_id + i) % 2 = 0 THEN '\\label{fig:P_' || i || '}' ELSE '' END || '\\end{figure}'"
_HEAD = "'\\documentclass{x}\\graphicspath{{img/}}\\begin{document}' || CASE WHEN doc_id % 2 = 0 THEN '\\input{parts/body}' ELSE '' END"
_BODY = "'\\begin{figure*}' || CASE WHEN doc_id % 4 = 0 THEN '\\includegraphics{near}' ELSE '' END || '\\caption{Body}\\end{figure*}'"


def _files(spark, sf_dir):
    """(package, name, content): figures follow their number, pictures lie at the top, in folders, twice or nowhere."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    there = "CASE (doc_id + i) % 5 WHEN 0 THEN array('p' || i || '.pdf', 'img/p' || i || '.png') WHEN 1 THEN array('img/p' || i || '.png') WHEN 2 THEN array('deep/p' || i || '.svg') WHEN 3 THEN array('x/p' || i || '.svg', 'y/p' || i || '.jpg') ELSE cast(array() AS array<string>) END"
    figs = f"transform(sequence(1, 1 + int(doc_id % 3)), i -> {_spark(_FIGURE)})"
    main = f"{_spark(_HEAD)} || array_join({figs}, char(10)) || coalesce(text, '')"
    pictures = f"flatten(transform(sequence(1, 1 + int(doc_id % 3)), i -> {there}))"
    made = f"concat(array(struct('main.tex' AS name, {main} AS content), struct('parts/body.tex' AS name, {_spark(_BODY)} AS content), struct('parts/near.eps' AS name, cast(NULL AS string) AS content)), transform({pictures}, x -> struct(x AS name, cast(NULL AS string) AS content)))"
    return d.select(F.col("doc_id").alias("package"), F.explode(F.expr(made)).alias("f")).select("package", "f.*")


def _found(spark, sf_dir):
    files = _files(spark, sf_dir)
    return fg.figure_files(p.assembled(files), files)


def st38(spark, sf_dir):
    return _found(spark, sf_dir).select("package", "n", "figure_id", "label", "caption", "environment", "file", "k", "role", "status", "path", "output")


_ST38 = """WITH m AS (SELECT doc_id AS package, i + (doc_id % 2 = 0)::INT AS n, i, (doc_id + i) % 5 AS way, CASE WHEN (doc_id + i) % 2 = 0 THEN 'fig:P_' || i ELSE '' END AS label FROM (SELECT doc_id, unnest(range(1, 2 + doc_id % 3)) AS i FROM documents)),
f AS (SELECT package, n, CASE WHEN label = '' THEN 'figure-' || n ELSE 'fig-p-' || i END AS slug, label, 'Fig ' || i AS caption, 'figure' AS environment, CASE WHEN package % 2 = 0 THEN 'parts/body.tex' ELSE 'main.tex' END AS file, 'primary' AS role, CASE way WHEN 0 THEN 'p' || i || '.pdf' WHEN 1 THEN 'img/p' || i || '.png' WHEN 2 THEN 'deep/p' || i || '.svg' END AS there, 'p' || i AS raw FROM m
UNION ALL SELECT doc_id, 1, 'figure-1', '', 'Body', 'figure*', 'parts/body.tex', CASE WHEN doc_id % 4 = 0 THEN 'primary' ELSE 'unknown' END, CASE WHEN doc_id % 4 = 0 THEN 'parts/near.eps' END, '' FROM documents WHERE doc_id % 2 = 0)
SELECT package, CAST(n AS INTEGER) AS n, 'fig::' || slug AS figure_id, label, caption, environment, file, 1 AS k, role, CASE WHEN there IS NULL THEN 'missing' ELSE 'copied' END AS status, coalesce(there, raw) AS path, CASE WHEN there IS NULL THEN '' ELSE 'figures/fig_' || printf('%03d', CAST(n AS INTEGER)) || '_' || slug || regexp_extract(there, '\\.[a-z]+$') END AS output FROM f"""

QUERIES = {
    "st38_figure_files": (st38, _ST38),
    "st38_figure_totals": (lambda s, d: fg.figure_totals(_found(s, d)), f"SELECT package, CAST(max(n) AS BIGINT) AS n_figures, count(*) FILTER (status = 'copied') AS n_copied, count(*) FILTER (status = 'missing') AS n_missing FROM ({_ST38}) GROUP BY package"),
}
