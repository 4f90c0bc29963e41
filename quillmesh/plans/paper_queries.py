"""Queries of TeX sources, bibliographies, citations, tool logs and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import citations as ct
from quillmesh.functions import tex
from quillmesh.operators import papers as p
from quillmesh.operators import retrieval as r
from quillmesh.plans.retrieval_queries import _COSINE, _bm25_sql
from quillmesh.session import table


def _spark(sql: str) -> str:
    """The same expression in Spark SQL, where a backslash in a literal is written twice."""
    return sql.replace("\\", "\\\\").replace("VARCHAR", "STRING").replace("chr(10)", "char(10)")


_COMMENTED = "'a 5\\% b %%c' || chr(10) || '%d' || chr(10) || coalesce(text, '') || 'x\\\\% y' || chr(10) || 'z'"
_PLAIN = "'\\textbf{A \\emph{b}} \\href{http://u}{link} $x$~' || coalesce(text, '')"
_SOURCE = """'\\title{On \\emph{Doc} ' || doc_id || '} % draft' || chr(10) || '\\author{\\textbf{Ann Lee} and \\textbf{Bo Wu ' || doc_id % 7 || '}}\\begin{abstract}In ' || coalesce(lang, 'none') || '.\\end{abstract}' || chr(10)
 || '\\section{Part ' || doc_id % 5 || '} A start. See \\citep[p. 2]{a' || doc_id || ', b}. End' || chr(10) || chr(10) || replace(replace(coalesce(text, ''), '\\', ''), '%', '') || chr(10) || chr(10)
 || '\\subsection*{More \\textbf{x}}\\begin{figure}\\caption{Cap {n}}\\label{f' || doc_id || '}\\end{figure}' || CASE WHEN doc_id % 2 = 0 THEN '\\appendix' ELSE '' END"""
_CITING = "'As Smith et al. (' || (1950 + doc_id % 60) || '; 2003b) and ' || coalesce(text, '') || chr(10) || '(see Lee, 1999a; ' || (1950 + doc_id % 60) || '; Kim and Wu 2010) show [1, 3-5], not ![7].'"
_SPACES = "[\\x{1C}-\\x{20}\\t-\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _docs(spark, sf_dir, sql: str, *columns: str):
    return table(spark, sf_dir, "documents").select("doc_id", *columns, F.expr(_spark(sql)).alias("s"))


def st29(spark, sf_dir):
    joined = lambda c, *fields: F.array_join(F.transform(f"x.{c}", lambda e: F.concat_ws(":", *[e[f] for f in fields])), "|").alias(c)
    found = _docs(spark, sf_dir, _SOURCE).select("doc_id", tex.tex_structure(F.col("s")).alias("x"))
    return found.select("doc_id", "x.title", F.array_join("x.authors", "|").alias("authors"), "x.abstract", joined("sections", "level", "title"), joined("floats", "kind", "label", "caption"), joined("cites", "n", "command", "section", "context", "key"), "x.has_appendix", "x.has_supplement")


_ST29 = """SELECT doc_id, 'On Doc ' || doc_id AS title, 'Ann Lee|Bo Wu ' || doc_id % 7 AS authors, 'In ' || coalesce(lang, 'none') || '.' AS abstract, 'section:Part ' || doc_id % 5 || '|subsection:More x' AS sections, 'figure:f' || doc_id || ':Cap n' AS floats,
'1:citep:Part ' || doc_id % 5 || ':See a' || doc_id || ', b.:a' || doc_id || '|1:citep:Part ' || doc_id % 5 || ':See a' || doc_id || ', b.:b' AS cites, doc_id % 2 = 0 AS has_appendix, false AS has_supplement FROM documents"""


def _entries(spark, sf_dir, entry: str):
    """(package, name, content): the parts of a brand as one or two files."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.expr("CASE WHEN p_brand LIKE '%5' OR p_partkey % 11 = 0 THEN 'r.bbl' ELSE 'f' || p_partkey % 2 || '.bib' END").alias("name"), "p_partkey", F.expr(_spark(entry)).alias("e"))
    return rows.groupBy("package", "name").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "e"))).alias("es")).select("package", "name", F.concat(F.array_join(F.transform("es", lambda x: x["e"]), "\n"), F.lit("\\end{thebibliography}")).alias("content"))


_BIB = "CASE WHEN p_brand LIKE '%5' OR p_partkey % 11 = 0 THEN '\\bibitem[x]{k' || p_partkey % 7 || '} Ann and Bo. ' || p_name || '. 19' || (10 + p_partkey % 90) || '.' ELSE '@Article{k' || p_partkey % 7 || ', title = {The {' || p_name || '} \\emph{case}},' || ' author = \"Ann and Bo\", note = {arXiv:20' || (10 + p_partkey % 20) || '.00001v2}, journal={J}, year={' || (1950 + p_partkey % 70) || '}}' END"

_ST28 = """WITH e AS (SELECT p_brand AS package, CASE WHEN p_brand LIKE '%5' OR p_partkey % 11 = 0 THEN 'r.bbl' ELSE 'f' || p_partkey % 2 || '.bib' END AS name, 'k' || p_partkey % 7 AS key, * FROM part),
k AS (SELECT *, min(name LIKE '%.bbl') OVER (PARTITION BY package) AS bbl FROM e), m AS (SELECT *, min(name) OVER (PARTITION BY package) AS source, row_number() OVER (PARTITION BY package, key ORDER BY name DESC, p_partkey DESC) AS back FROM k WHERE (name LIKE '%.bbl') = bbl)
SELECT package, key, source, CASE WHEN bbl THEN 'unknown' ELSE 'article' END AS type, CASE WHEN bbl THEN p_name ELSE 'The ' || p_name || ' case' END AS title, 'Ann and Bo' AS authors, CASE WHEN bbl THEN '19' || (10 + p_partkey % 90) ELSE CAST(1950 + p_partkey % 70 AS VARCHAR) END AS year,
CASE WHEN bbl THEN '' ELSE 'J' END AS venue, '' AS doi, CASE WHEN bbl THEN '' ELSE '20' || (10 + p_partkey % 20) || '.00001' END AS arxiv_id FROM m WHERE back = 1"""


def st36(spark, sf_dir):
    entry = "'@misc{k' || p_partkey || ', note = {x {' || p_name || '} y} , title = {' || p_type || '}, Note=\"q\", year=2001, note = bare}'"
    return table(spark, sf_dir, "part").select("p_partkey", tex.without_field(F.expr(entry)).alias("v"))


def st30(spark, sf_dir):
    fields = {"title": F.col("p_name"), "author": F.col("p_brand"), "note": F.when(F.col("p_size") > 25, F.lit("")), "year": (1950 + F.col("p_partkey") % 70).cast("string")}
    return table(spark, sf_dir, "part").select("p_partkey", tex.bibtex(F.lit("misc"), F.concat(F.lit("k"), "p_partkey"), fields).alias("v"))


def st14(spark, sf_dir):
    found = _docs(spark, sf_dir, _CITING).select("doc_id", ct.citations(F.col("s")).alias("c"))
    of = lambda kind: F.filter("c", lambda x: x["kind"] == kind)
    named = lambda kind: F.array_join(F.flatten(F.transform(of(kind), lambda x: F.transform(x["cited"], lambda a: F.concat_ws(" ", a["author"], a["year"])))), "|").alias(kind)
    return found.select("doc_id", named("textual"), named("parenthetical"), F.array_join(F.transform(of("numeric"), lambda x: x["raw"]), "|").alias("numeric"))


_ST14 = f"""SELECT doc_id, 'Smith et al. ' || (1950 + doc_id % 60) || '|Smith et al. 2003b' AS textual, 'Lee 1999a|Lee ' || (1950 + doc_id % 60) || '|Kim 2010' AS parenthetical,
array_to_string(regexp_extract_all({_CITING}, '(?:^|[^!])(\\[[0-9]+(?:\\s*[,–-]\\s*[0-9]+)*\\])', 1), '|') AS numeric FROM documents"""


def dc11(spark, sf_dir):
    docs = _docs(spark, sf_dir, _CITING).select(F.col("doc_id").alias("paper"), F.col("s").alias("text"))
    refs = docs.select("paper", F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f"r{i}").alias("ref"), F.lit(s).alias("surname"), F.lit(y).alias("year")) for i, s, y in _REFERENCES])).alias("x")).select("paper", "x.*")
    found = p.cited_references(docs, refs)
    lines = F.col("line").cast("long") - F.min("line").over(p.Window.partitionBy("paper"))
    return found.filter("kind <> 'numeric' or raw = '[1, 3-5]'").select("paper", "kind", lines.alias("lines_below"), "author", "year", "rung", F.col("n_refs").cast("long").alias("n_refs"), "first_ref")


_REFERENCES = ((1, "smith", "2003b"), (2, "lee", "1999a"), (3, "lee", "1970b"), (4, "lee", "1970"), (5, "kim", "2011"))
_DC11 = f"""WITH refs AS (SELECT * FROM (VALUES {', '.join(f"({i}, 'r{i}', '{s}', '{y}')" for i, s, y in _REFERENCES)}) AS v(pos, ref, surname, year)),
d AS (SELECT doc_id AS paper, CAST(1950 + doc_id % 60 AS VARCHAR) AS y, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS BIGINT) AS below FROM documents),
c AS (SELECT paper, 'textual' AS kind, 0 AS lines_below, 'Smith et al.' AS author, 'smith' AS s, unnest([y, '2003b']) AS year FROM d UNION ALL SELECT paper, 'parenthetical', below, 'Lee', 'lee', unnest(['1999a', y]) FROM d UNION ALL SELECT paper, 'parenthetical', below, 'Kim', 'kim', '2010' FROM d UNION ALL SELECT paper, 'numeric', below, '', '', unnest(['1', '3', '4', '5']) FROM d),
m AS (SELECT c.*, ref, CASE WHEN r.year = c.year OR kind = 'numeric' THEN 1 ELSE 2 END AS k FROM c LEFT JOIN refs r ON CASE WHEN kind = 'numeric' THEN CAST(pos AS VARCHAR) = c.year ELSE surname = s AND r.year[1:4] = c.year[1:4] END),
b AS (SELECT *, min(k) OVER (PARTITION BY paper, kind, author, year) AS best FROM m)
SELECT paper, kind, lines_below, author, year, CASE WHEN min(ref) IS NULL THEN 0 ELSE CAST(min(k) AS INTEGER) END AS rung, count(ref) AS n_refs, min(ref) AS first_ref FROM b WHERE k = best GROUP BY paper, kind, lines_below, author, year"""


def _lists(spark, sf_dir):
    """(brand, lines): three lines a part, a blank one before every third part, and no full stop at the end of every fifth."""
    lines = F.array(F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")), F.expr("'Ann, B. ' || (1950 + p_partkey % 70) || '.  ' || p_name"), F.lit("in the pro-"), F.when(F.col("p_partkey") % 5 == 1, F.lit("ceedings of x")).otherwise(F.lit("ceedings of x.")))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.array_compact(lines).alias("lines"))
    return rows.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "lines"))).alias("l")).select("p_brand", F.flatten(F.transform("l", lambda x: x["lines"])).alias("lines"))


def wn5b(spark, sf_dir):
    return _lists(spark, sf_dir).select("p_brand", F.posexplode(p.markdown_references(F.col("lines"))).alias("pos", "entry")).select("p_brand", F.col("pos").cast("long").alias("pos"), "entry")


_WN5B = """WITH l AS (SELECT p_brand, p_partkey, 'Ann, B. ' || (1950 + p_partkey % 70) || '. ' || p_name || ' in the proceedings of x' || CASE WHEN p_partkey % 5 = 1 THEN '' ELSE '.' END AS s,
CASE WHEN p_partkey % 3 = 0 OR lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) % 5 <> 1 THEN 1 ELSE 0 END AS fresh, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 AS first FROM part),
g AS (SELECT *, sum(CASE WHEN first THEN 0 ELSE fresh END) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM l) SELECT p_brand, CAST(pos AS BIGINT) AS pos, string_agg(s, ' ' ORDER BY p_partkey) AS entry FROM g GROUP BY p_brand, pos"""


def wn9(spark, sf_dir):
    words = F.split("p_name", " ")
    shorter = F.concat(F.slice(words, 1, 1), F.slice(words, F.lit(3), F.size(words)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(p.only_left(words, shorter), "|").alias("samples"))


_LOGGED = """CASE event_id % 6 WHEN 0 THEN '{"type": "context.append_loop_event", "time": "t1", "event": {"type": "tool.call", "toolCallId": "c' || event_id || '", "name": "' || event_type || '", "args": ' || props || '}}'
 WHEN 1 THEN '{"type": "tool.result", "time": "t2", "toolCallId": "c' || event_id || '", "parentUuid": "p", "result": {"output": "", "stdout": "' || repeat(event_type, 500) || '"}}' WHEN 2 THEN '{"type": "tool.result", "toolCallId": "c' || event_id || '", "result": "' || event_type || '"}'
 WHEN 3 THEN '{"type": "usage.record", "usage": {}}' WHEN 4 THEN '{broken' ELSE '{"type": "context.append_loop_event", "event": "none"}' END"""

_SC14 = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'tool.call' ELSE 'tool.result' END AS type, CASE event_id % 6 WHEN 0 THEN 't1' WHEN 1 THEN 't2' END AS time, 'c' || event_id AS tool_call_id, CASE event_id % 6 WHEN 0 THEN event_type END AS name, CASE event_id % 6 WHEN 0 THEN replace(props, ' ', '') END AS args,
CASE event_id % 6 WHEN 1 THEN 'p' END AS parent, CAST(CASE event_id % 6 WHEN 1 THEN 500 * length(event_type) WHEN 2 THEN length(event_type) END AS INTEGER) AS output_chars, CASE event_id % 6 WHEN 1 THEN substr(repeat(event_type, 500), 1, 2000) WHEN 2 THEN event_type END AS output_preview FROM events WHERE event_id % 6 < 3"""


def _resources(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("paper"), F.concat(F.lit("r"), "p_partkey").alias("resource_id"), F.col("p_name").alias("name"), F.expr("CASE p_size % 3 WHEN 0 THEN 'github_mcp' WHEN 1 THEN '' END").alias("repository_checked_by"), F.expr("CASE p_size % 2 WHEN 0 THEN 'web' END").alias("checked_by"), F.expr("CASE p_size % 5 WHEN 0 THEN 'available' END").alias("status"), F.lit(None).cast("string").alias("url"), F.col("p_type").alias("notes"))


def dc13(spark, sf_dir):
    stated = table(spark, sf_dir, "region").select(F.lit("Brand#11").alias("paper"), F.concat(F.lit("x"), "r_regionkey").alias("resource_id"), F.col("r_name").alias("name"), F.lit("agent").alias("method"), F.lit("ok").alias("status"), F.lit("").alias("url"), F.lit("").alias("notes"))
    return p.verification_checks(stated, _resources(spark, sf_dir))


_DC13 = """SELECT 'Brand#11' AS paper, 'stated' AS origin, 'x' || r_regionkey AS resource_id, r_name AS name, 'agent' AS method, 'ok' AS status, '' AS url, '' AS notes FROM region
UNION ALL SELECT p_brand, 'resource', 'r' || p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN 'github_mcp' WHEN p_size % 2 = 0 THEN 'web' ELSE 'agent' END, CASE WHEN p_size % 5 = 0 THEN 'available' ELSE 'unknown' END, '', p_type FROM part"""


def rt7(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    said = part.select(F.col("p_partkey").alias("id"), F.expr("CASE p_size % 3 WHEN 0 THEN 'Claim' ELSE 'Question' END").alias("kind"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    asked = part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("q"), F.col("p_name").alias("text"), F.expr("CASE p_partkey % 40 WHEN 0 THEN 'Claim' END").alias("kind"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = r.semantic(e.filter("id % 20 = 0").withColumnRenamed("id", "q"), e, 5 * r.POOL)
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lit("FROM").alias("type"), F.concat(F.lit("paper_"), "l_suppkey").alias("dst"))
    found = p.find_statements(asked, said, near, edges)
    return found.select("q", "id", F.col("place").cast("long").alias("place"), "evidence", "kind", "text", "reusable", F.array_join("papers", ",").alias("papers"))


_RT7 = f"""WITH said AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Claim' ELSE 'Question' END AS kind, p_type || ' ' || p_name AS text FROM part), asked AS (SELECT p_partkey AS q, p_name AS text, CASE p_partkey % 40 WHEN 0 THEN 'Claim' END AS wanted FROM part WHERE p_partkey % 20 = 0),
{_bm25_sql('asked', 'said', 'bytext')}, near AS (SELECT a.vec_id AS q, b.vec_id AS id, {_COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) <= 100),
c AS (SELECT q, 'lexical_text' AS channel, id, score FROM bytext UNION ALL SELECT q, 'semantic', id, score FROM near), k AS (SELECT c.* FROM c JOIN asked USING (q) JOIN said USING (id) WHERE wanted IS NULL OR wanted = kind),
ranked AS (SELECT q, channel, id, row_number() OVER (PARTITION BY q, channel ORDER BY score DESC, id) AS rank FROM k QUALIFY rank <= 20),
f AS (SELECT q, id, round(sum(1.0::DOUBLE / (10 + rank)), 9) AS rrf, array_to_string(list_sort(list(channel || ':' || CAST(rank AS VARCHAR))), ',') AS evidence FROM ranked GROUP BY q, id),
n AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY rrf DESC, id) AS place, evidence FROM f QUALIFY place <= 5), o AS (SELECT l_partkey AS id, array_to_string(list_sort(list(DISTINCT 'paper_' || l_suppkey)), ',') AS papers FROM lineitem GROUP BY l_partkey)
SELECT q, id, place, evidence, kind, text, kind <> 'Claim' AS reusable, coalesce(papers, '') AS papers FROM n JOIN said USING (id) LEFT JOIN o USING (id)"""


def dc15(spark, sf_dir):
    patches = [("names", lambda d: "p_name" in d.columns, lambda d: d.withColumn("p_name", F.upper("p_name"))), ("prices", lambda d: "price" in d.columns, lambda d: d.drop("price")), ("broken", lambda d: True, lambda d: d.select("no_such_column")), ("sizes", lambda d: True, lambda d: d.withColumn("p_size", F.col("p_size") + 1))]
    df, _ = p.supplemented(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size")), patches)
    return df


QUERIES = {
    "st27_tex_comments": (lambda s, d: _docs(s, d, _COMMENTED).select("doc_id", tex.without_comments(F.col("s")).alias("v")), f"SELECT doc_id, regexp_replace({_COMMENTED}, '(^|[^\\\\])((?:\\\\\\\\)*)%[^\\n]*', '\\1\\2', 'g') AS v FROM documents"),
    "st27_plain_tex": (lambda s, d: _docs(s, d, _PLAIN).select("doc_id", tex.plain_tex(F.col("s")).alias("v")), f"SELECT doc_id, 'A b link (http://u) ' || trim(regexp_replace('x ' || replace(replace(regexp_replace(replace(replace(coalesce(text, ''), '$', ''), '~', ' '), '\\\\[a-zA-Z]+\\*?(?:\\[[^\\]]*\\])?|\\\\.', ' ', 'g'), '{{', ''), '}}', ''), '{_SPACES}', ' ', 'g')) AS v FROM documents"),
    "st28_bibliographies": (lambda s, d: p.package_references(_entries(s, d, _BIB)), _ST28),
    "st29_tex_structure": (st29, _ST29),
    "st30_bibtex": (st30, "SELECT p_partkey, '@misc{k' || p_partkey || ',' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  author = {' || p_brand || '},' || chr(10) || '  year = {' || (1950 + p_partkey % 70) || '}' || chr(10) || '}' AS v FROM part"),
    "st36_without_notes": (st36, "SELECT p_partkey, '@misc{k' || p_partkey || ',  title = {' || p_type || '},  year=2001, }' AS v FROM part"),
    "st14_citations": (st14, _ST14),
    "dc11_cited_references": (dc11, _DC11),
    "wn5b_markdown_references": (wn5b, _WN5B),
    "wn9_sequence_differences": (wn9, "SELECT p_partkey, coalesce(string_split(p_name, ' ')[2], '') AS samples FROM part"),
    "sc14_wire_events": (lambda s, d: p.wire_events(table(s, d, "events").select("event_id", F.expr(_LOGGED).alias("value"))), _SC14),
    "dc13_verification_checks": (dc13, _DC13),
    "dc13_run_report": (lambda s, d: p.run_report(_resources(s, d)), "SELECT p_brand AS paper, count(*) AS resource_count, count_if(p_size % 3 = 0) AS github_checked_count FROM part GROUP BY p_brand"),
    "rt7_find_statements": (rt7, _RT7),
    "dc15_supplements": (dc15, "SELECT p_partkey, upper(p_name) AS p_name, CAST(p_size + 1 AS INTEGER) AS p_size FROM part"),
    "ma2_half_even": (lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity").cast("double") / 16, 3).alias("v")), "SELECT l_orderkey, l_linenumber, round_even(CAST(l_quantity AS DOUBLE) / 16, 3) AS v FROM lineitem"),
}
