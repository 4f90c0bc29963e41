"""Queries of papers as text and of picture names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import formatting as f
from quillmesh.session import table


def dc5(spark, sf_dir):
    """Each document as a paper: a section a line, of depths that rise and fall with it, some without text, anchor or title."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    lines = docs.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    p = F.col("pos")
    sections = lines.select(
        F.col("doc_id").alias("paper"), "pos", F.when(p == 0, 0).otherwise((p + i) % 3).cast("int").alias("depth"), (F.when(p == 0, 2).otherwise((p + i) % 3 * 3 + 2)).cast("int").alias("level"),
        F.substring("line", 1, 20).alias("title"), F.when(p % 4 != 1, F.col("line")).alias("markdown"), F.when(p % 3 == 1, F.concat(F.lit("S<"), p.cast("string"))).alias("anchor"),
    )
    papers = docs.select(
        i.alias("paper"), F.concat(F.lit("2001."), i.cast("string")).alias("arxiv_id"), F.when(i % 3 == 0, F.concat(F.lit("v"), (i % 5).cast("string"))).alias("version"),
        F.when(i % 4 != 0, F.concat(F.lit('On "'), F.coalesce("lang", F.lit("none")), F.lit('" \\ more'))).alias("title"),
        F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Ann Lee"), F.concat(F.lit("Bo "), F.coalesce("source", F.lit("-"))))).alias("authors"),
        F.when(i % 6 == 0, " ").when(i % 6 > 2, F.concat(F.lit(" abstract "), i.cast("string"))).alias("abstract"), F.when(i % 2 == 0, F.concat(i.cast("string"), F.lit("k"))).alias("tokens"),
    )
    found = f.format_papers(papers, sections)
    return found.select("paper", "summary", F.md5("tree").alias("tree"), F.md5("content").alias("content"), "header")


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_QUOTED = """'"' || replace(replace({0}, '\\', '\\\\'), '"', '\\"') || '"'"""
_DC5 = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id AS paper, pos, CASE WHEN pos = 0 THEN 0 ELSE (pos + doc_id) % 3 END AS depth, CASE WHEN pos = 0 THEN 2 ELSE (pos + doc_id) % 3 * 3 + 2 END AS level, substr(line, 1, 20) AS title, CASE WHEN pos % 4 <> 1 THEN nullif(line, '') END AS md, CASE WHEN pos % 3 = 1 THEN 'S&lt;' || pos END AS anchor FROM l),
b AS (SELECT paper, count(*) AS n, string_agg(repeat(' ', (4 * depth)::INT) || title, chr(10) ORDER BY pos) AS tree, string_agg(repeat('  ', depth::INT) || '- ' || title, chr(10) ORDER BY pos) AS toc,
 string_agg(coalesce('<a id="' || anchor || '" name="' || anchor || '"></a>' || chr(10), '') || repeat('#', least(level, 6)::INT) || ' ' || title || coalesce(chr(10) || chr(10) || md, ''), chr(10) || chr(10) ORDER BY pos) AS body FROM s GROUP BY paper),
p AS (SELECT doc_id AS paper, '2001.' || doc_id AS ax, CASE WHEN doc_id % 3 = 0 THEN 'v' || (doc_id % 5) END AS version, CASE WHEN doc_id % 4 <> 0 THEN 'On "' || coalesce(lang, 'none') || '" \\ more' END AS title, CASE WHEN doc_id % 5 = 0 THEN [] ELSE ['Ann Lee', 'Bo ' || coalesce(source, '-')] END AS authors,
 CASE WHEN doc_id % 6 = 0 THEN ' ' WHEN doc_id % 6 > 2 THEN ' abstract ' || doc_id END AS abstract, CASE WHEN doc_id % 2 = 0 THEN doc_id || 'k' END AS tokens FROM documents)
SELECT p.paper, concat_ws(chr(10), 'Title: ' || title, 'ArXiv: ' || ax, 'Version: ' || version, CASE WHEN len(authors) > 0 THEN 'Authors: ' || array_to_string(authors, ', ') END, 'Sections: ' || coalesce(n, 0), 'Estimated tokens: ' || tokens) AS summary,
md5('Sections:' || chr(10) || 'Abstract' || chr(10) || coalesce(tree, '')) AS tree,
md5({_STRIP.format("concat_ws(chr(10) || chr(10), '## Contents' || chr(10) || toc, CASE WHEN abstract IS NOT NULL THEN '## Abstract' END, nullif(trim(abstract), ''), body)")}) AS content,
concat_ws(chr(10), '---', 'title: ' || {_QUOTED.format('title')}, 'version: "' || version || '"', CASE WHEN len(authors) > 0 THEN 'authors: [' || array_to_string(list_transform(authors, lambda a: {_QUOTED.format('a')}), ', ') || ']' END, 'url: "https://arxiv.org/abs/' || ax || '"', 'sections: ' || coalesce(n, 0), 'estimated_tokens: "' || tokens || '"', '---') AS header
FROM p LEFT JOIN b USING (paper)"""


def st35(spark, sf_dir):
    """The pictures of each order's lines, many under the same name in other folders, and its Markdown with local links."""
    c = F.col
    url = F.concat(F.lit("https://h"), (c("l_suppkey") % 4).cast("string"), F.lit("/a b/"), F.element_at(F.array(*[F.lit(x) for x in ("fig.png", "fig", "x%y.tar.gz", "")]), (c("l_partkey") % 4 + 1).cast("int")), F.when(c("l_linenumber") % 2 == 0, "?v=1").otherwise(""))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.replace(url, F.lit(" "), F.lit("_")).alias("url"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(place)).alias("p"))
    urls = F.transform("p", lambda x: x["url"])
    text = F.array_join(F.transform(urls, lambda u: F.concat(F.lit("![p]("), u, F.lit(") [l]("), u, F.lit(")"))), " ")
    named = rows.select("l_orderkey", text.alias("text")).withColumn("names", f.image_names(f.remote_images(c("text"))))
    return named.select("l_orderkey", F.array_join(F.transform("names", lambda n: n["name"]), "|").alias("names"), F.md5(f.localized(c("text"), c("names"), "img")).alias("text"))


_ST35 = """WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'https://h' || (l_suppkey % 4) || '/a_b/' || ['fig.png', 'fig', 'x%y.tar.gz', ''][l_partkey % 4 + 1] || CASE WHEN l_linenumber % 2 = 0 THEN '?v=1' ELSE '' END AS url, ['fig.png', 'fig', 'x_y.tar.gz', 'a_b'][l_partkey % 4 + 1] AS name FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, url) AS i FROM u), d AS (SELECT l_orderkey, url, any_value(name) AS name, min(i) AS i FROM o GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, name ORDER BY i) AS k FROM d), n AS (SELECT l_orderkey, url, i, CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '(\\.[^.]*)?$', '-' || k || '\\1') END AS name FROM k)
SELECT l_orderkey, (SELECT string_agg(name, '|' ORDER BY i) FROM n WHERE n.l_orderkey = o.l_orderkey) AS names, md5(string_agg('![p](img/' || n.name || ') [l](' || o.url || ')', ' ' ORDER BY o.i)) AS text FROM o JOIN n USING (l_orderkey, url) GROUP BY l_orderkey"""

QUERIES = {
    "dc5_formatted_papers": (dc5, _DC5),
    "st35_picture_names": (st35, _ST35),
}
