"""Queries of TeX packages, content lists, chosen references, merged texts, boxes and ids, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import tex
from quillmesh.functions import text as t
from quillmesh.operators import packages as p
from quillmesh.plans.paper_queries import _SOURCE, _spark
from quillmesh.session import table
from quillmesh.sources import adapters as a
from quillmesh.sources.adapters import oracle


def _files(spark, sf_dir):
    """(package, name, content): each document as a package of a main file, a part in a folder, a supplement and references."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_spark(_SOURCE)).alias("body"))
    file = lambda name, content: F.struct(F.lit(name).alias("name"), F.expr(_spark(content)).alias("content"))
    made = F.array(
        file("main.tex", "'\\documentclass{x}\\begin{document}\\input{body} \\include{none}' || CASE WHEN doc_id % 3 = 0 THEN '\\input{parts/body}' ELSE '' END"),
        F.struct(F.lit("parts/body.tex").alias("name"), F.col("body").alias("content")),
        file("supp.tex", "'\\documentclass{x}\\begin{document}\\title{Other}'"),
        file("r.bib", "'@misc{a' || doc_id || ', title={Ref ' || doc_id || '}, note={arXiv:20' || (10 + doc_id % 20) || '.00001}} @misc{c, title={C}}'"),
    )
    return d.select("doc_id", F.explode(made).alias("f")).select(F.col("doc_id").alias("package"), "f.*")


def sc9(spark, sf_dir):
    return p.assembled(_files(spark, sf_dir)).select("package", "main", "source", F.array_join("included", "|").alias("included"))


def sc9_hints(spark, sf_dir):
    """The main file of packages whose 00README.json names a path, a base name, nothing usable, a file that is not there, or is broken."""
    files = _files(spark, sf_dir).select("package", "name", "content")
    said = F.element_at(F.array(*[F.lit(x) for x in _READMES]), (F.col("package") % len(_READMES) + 1).cast("int"))
    readme = files.filter("name = 'main.tex'").select("package", F.lit("anc/00README.json").alias("name"), said.alias("content"))
    return p.assembled(files.unionByName(readme)).select("package", "main", F.size("included").cast("long").alias("n_included"))


_READMES = (
    '{"sources": [{"usage": "ignore", "filename": "main.tex"}, {"usage": "toplevel", "filename": "./parts/body.tex"}]}',
    '{"sources": [{"usage": "toplevel", "filename": "gone.tex"}, {"usage": "toplevel", "filename": "body.tex"}]}',
    '{"sources": [{"usage": "ignore", "filename": "supp.tex"}]}',
    '{"sources": [{"usage": "toplevel", "filename": "gone.tex"}]}',
    "{broken",
    '{"sources": [{"usage": "toplevel", "filename": "supp.tex"}, {"usage": "toplevel", "filename": "main.tex"}]}',
)
_SC9_HINTS = f"""WITH m AS (SELECT doc_id, CASE WHEN doc_id % {len(_READMES)} IN (0, 1) THEN 'parts/body.tex' WHEN doc_id % {len(_READMES)} = 5 THEN 'supp.tex' ELSE 'main.tex' END AS main FROM documents)
SELECT doc_id AS package, main, CASE WHEN main <> 'main.tex' THEN 0 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_included FROM m"""

_BEGIN, _END = "chr(10) || '% BEGIN included from parts/body.tex' || chr(10)", "chr(10) || '% END included from parts/body.tex' || chr(10)"
_SC9 = f"""SELECT doc_id AS package, 'main.tex' AS main, '\\documentclass{{x}}\\begin{{document}}' || {_BEGIN} || {_SOURCE} || {_END} || ' \\include{{none}}' || CASE WHEN doc_id % 3 = 0 THEN {_BEGIN} || {_END} ELSE '' END AS source,
'parts/body.tex' || CASE WHEN doc_id % 3 = 0 THEN '|parts/body.tex' ELSE '' END AS included FROM documents"""


def dc14(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    known = d.filter("doc_id % 4 < 3").select(F.col("doc_id").alias("package"), F.expr("CASE WHEN doc_id % 4 < 2 THEN '2001.' || doc_id END").alias("arxiv_id"), F.expr("CASE WHEN doc_id % 4 = 0 THEN 'Known ' || doc_id ELSE '' END").alias("title"), F.lit(None).cast("array<string>").alias("authors"), F.lit("2001").alias("year"), F.lit("").alias("abstract"))
    found = p.parsed_packages(_files(spark, sf_dir), known)
    u, m = "content_units", "metadata"
    return found.select("package", "main", "n_included", "n_references", "n_citations", "n_sections", "paper_id", f"{m}.title", F.array_join(f"{m}.authors", "|").alias("authors"), f"{m}.year", f"{m}.venue", f"{m}.url", f"{u}.abstract", f"{u}.has_appendix", F.size(f"{u}.figures").alias("n_figures"), F.array_join(F.transform("contexts", lambda c: F.concat_ws(":", c["cite_key"], c["reference_title"], c["section"])), "|").alias("contexts"), F.array_join("cites", "|").alias("cites"))


_DC14 = """WITH d AS (SELECT *, CASE WHEN doc_id % 4 < 2 THEN '2001.' || doc_id ELSE '' END AS ax FROM documents)
SELECT doc_id AS package, 'main.tex' AS main, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS n_included, 2 AS n_references, 2 AS n_citations, 2 AS n_sections, 'paper::' || ax AS paper_id, CASE WHEN doc_id % 4 = 0 THEN 'Known ' || doc_id ELSE 'On Doc ' || doc_id END AS title, 'Ann Lee|Bo Wu ' || doc_id % 7 AS authors,
CASE WHEN doc_id % 4 < 3 THEN '2001' ELSE 'unknown' END AS year, CASE WHEN ax = '' THEN '' ELSE 'arXiv ' || ax END AS venue, CASE WHEN ax = '' THEN '' ELSE 'https://arxiv.org/abs/' || ax END AS url, 'In ' || coalesce(lang, 'none') || '.' AS abstract, doc_id % 2 = 0 AS has_appendix, 1 AS n_figures,
'a' || doc_id || ':Ref ' || doc_id || ':Part ' || doc_id % 5 || '|b::Part ' || doc_id % 5 AS contexts, 'paper::20' || (10 + doc_id % 20) || '.00001' AS cites FROM d"""


def sc7(spark, sf_dir):
    """Each document as one list: its lines as text blocks, a list and a table; every third as a list of pages."""
    block = F.transform(F.split("text", "\n"), lambda x: F.to_json(F.struct(F.lit("text").alias("type"), x.alias("text"), F.lit(2).alias("text_level"))))
    more = F.array(F.lit('{"type": "list", "list_items": ["a", "b"], "page_idx": 7}'), F.lit('{"type": "table", "table_caption": ["t"], "image_caption": ["i"], "extra": {"x": [1]}}'))
    joined = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    pages = F.concat(F.lit("["), joined(block), F.lit(","), joined(more), F.lit("]"))
    lists = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNull(), F.lit("{broken")).when(F.col("doc_id") % 3 == 0, pages).otherwise(joined(F.concat(block, more))).alias("content"))
    return p.content_blocks(lists).select("doc_id", F.col("pos").cast("long").alias("pos"), "type", "text", "text_level", "page_idx", F.array_join("list_items", ",").alias("items"), F.array_join("captions", ",").alias("captions"))


_SC7 = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(unnest(range(len(lines))) AS BIGINT) AS pos, 'text' AS type, unnest(lines) AS text, 2 AS text_level, CASE WHEN doc_id % 3 = 0 THEN 0 END AS page_idx, CAST(NULL AS VARCHAR) AS items, '' AS captions FROM l
UNION ALL SELECT doc_id, len(lines), 'list', NULL, NULL, 7, 'a,b', '' FROM l UNION ALL SELECT doc_id, len(lines) + 1, 'table', NULL, NULL, CASE WHEN doc_id % 3 = 0 THEN 1 END, NULL, 'i,t' FROM l"""


def dc9(spark, sf_dir):
    some = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("e"), i))
    size = F.col("p_size").cast("int")
    listed = F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).when(F.col("p_partkey") % 5 == 1, F.array().cast("array<string>")).otherwise(some(F.lit(20)))
    marked = F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(some(size))
    found = p.chosen_references(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper"), listed.alias("listed"), marked.alias("marked")))
    return found.select("paper", "source", F.size("chosen").alias("n"), F.array_join("warnings", "|").alias("warnings"))


_DC9 = """WITH x AS (SELECT p_partkey AS paper, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 20 END AS l, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS m FROM part),
y AS (SELECT *, coalesce(l, 0) = 0 AND m IS NOT NULL AS back FROM x), z AS (SELECT *, CAST(CASE WHEN back THEN m ELSE coalesce(l, 0) END AS INTEGER) AS n FROM y)
SELECT paper, CASE WHEN back THEN 'markdown_fallback' ELSE 'content_list' END AS source, n, concat_ws('|', CASE WHEN l IS NULL THEN 'missing content list' END, CASE WHEN l > 0 AND m > 0 AND abs(m - l) > greatest(5, floor(0.25 * m)) THEN 'content list has 20 candidates, Markdown ' || m END,
CASE WHEN m IS NULL THEN 'missing Markdown' END, CASE WHEN n = 0 THEN 'no references' END) AS warnings FROM z"""


def wn6(spark, sf_dir):
    text = F.when(F.col("idx") % 5 == 4, F.lit(" ")).when(F.col("idx") % 3 == 2, F.concat(F.lit("续"), "idx")).otherwise(F.concat_ws(" ", "type", "idx"))
    return p.merged_texts(a.blocks(spark, sf_dir).withColumn("text", text)).select("doc", "first_idx", "text")


_WN6 = """, x AS (SELECT doc, idx, merge_prev, CASE WHEN idx % 3 = 2 THEN '续' || idx ELSE type || ' ' || idx END AS s FROM blocks WHERE idx % 5 <> 4), r AS (SELECT *, sum(CASE WHEN merge_prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY idx) AS run FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY doc, run ORDER BY idx) = 1 AS first FROM r) SELECT doc, min(idx) AS first_idx, string_agg(CASE WHEN first OR contains(s, '续') THEN s ELSE ' ' || s END, '' ORDER BY idx) AS text FROM f GROUP BY doc, run"""


def ma1(spark, sf_dir):
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    fixed = tuple(F.lit(x) for x in (0.1, 0.1, 0.4, 0.4))
    rel = t.relative_box(box, fixed)
    return a.blocks(spark, sf_dir).select("doc", "idx", F.round(t.box_gap(box, fixed), 6).alias("gap"), F.round(t.box_centre_distance(box, fixed), 6).alias("centre"), *[F.get(rel, i).alias(f"r{i}") for i in range(4)])


_REL = ", ".join(f"round(least(greatest(({c} - 0.1::DOUBLE) / (0.4::DOUBLE - 0.1::DOUBLE), 0), 1), 3) AS r{i}" for i, c in enumerate(("x0", "y0", "x1", "y1")))
_MA1 = f" SELECT doc, idx, round(sqrt(greatest(x0 - 0.4, 0.1 - x1, 0) ** 2 + greatest(y0 - 0.4, 0.1 - y1, 0) ** 2), 6) AS gap, round(sqrt(((x0 + x1 - 0.5) / 2) ** 2 + ((y0 + y1 - 0.5) / 2) ** 2), 6) AS centre, {_REL} FROM blocks"


def st21(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    made = t.resource_id(F.lit("id"), tex.plain_tex(F.concat(F.lit("\\emph{"), "p_name", F.lit("}~x"))))
    return part.select("p_partkey", t.resource_id(F.lit("dataset"), F.when(F.col("p_size") > 40, F.lit(" -- ")).otherwise(F.col("p_brand"))).alias("resource"), made.alias("made"), t.anthology_id(F.when(F.col("p_size") % 2 == 0, F.lit("P19")).otherwise(F.lit("2020.acl")), F.lit("1"), F.col("p_partkey").cast("string")).alias("paper"))


QUERIES = {
    "sc9_hinted_mains": (sc9_hints, _SC9_HINTS),
    "sc9_tex_packages": (sc9, _SC9),
    "dc14_parsed_packages": (dc14, _DC14),
    "sc7_content_blocks": (sc7, _SC7),
    "dc9_chosen_references": (dc9, _DC9),
    "wn6_merged_texts": (wn6, oracle("blocks", _WN6)),
    "ma1_box_distances": (ma1, oracle("blocks", _MA1)),
    "st21_ids": (st21, "SELECT p_partkey, 'dataset::' || CASE WHEN p_size > 40 THEN 'unknown' ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') END AS resource, 'id::' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-x' AS made, CASE WHEN p_size % 2 = 0 THEN 'P19-1' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END ELSE '2020.acl-1.' || p_partkey END AS paper FROM part"),
}
