"""Queries of references, citations, positions and records over the adapted tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import bibliography as b
from quillmesh.operators import records as r
from quillmesh.session import table
from quillmesh.sources import adapters as a
from quillmesh.sources.adapters import oracle

_LOOSE = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_KEYED = f""", keyed AS (SELECT *, CASE WHEN {_LOOSE.format('title')} <> '' THEN {_LOOSE.format('title')} ELSE {_LOOSE.format('raw')} END AS key, CASE WHEN {_LOOSE.format('title')} <> '' THEN 'title' ELSE 'raw' END AS key_type FROM mentions),
idx AS (SELECT key, key_type, count(*) AS mention_count, count(DISTINCT paper_id) AS citing_paper_count, min(paper_id) AS first_paper, count(DISTINCT year) AS n_years FROM keyed WHERE key <> '' GROUP BY key, key_type)"""


def _top_sql(column: str, n: int) -> str:
    return oracle("mentions", f"{_KEYED}, c AS (SELECT key, {column} AS value, count(*) AS n, min(struct_pack(p := paper_id, s := ref_seq)) AS first FROM keyed WHERE key <> '' GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS place FROM c QUALIFY place <= {n}) SELECT key, array_to_string(list(value || ':' || CAST(n AS VARCHAR) ORDER BY place), ',') AS top FROM p GROUP BY key")


def _top(column: str, n: int):
    return lambda spark, sf_dir: b.top_values(a.mentions(spark, sf_dir), column, n).select("key", F.array_join("values", ",").alias("top"))


def tk4(spark, sf_dir):
    """The whole index in its order."""
    index = b.reference_index(a.mentions(spark, sf_dir))
    return index.orderBy(F.desc("mention_count"), "key_type", "key").select("key", "key_type", "mention_count")


def _two_sources(spark, sf_dir):
    m = a.mentions(spark, sf_dir).select("paper_id", F.col("ref_seq").alias("seq"), "raw")
    n = F.regexp_extract("paper_id", "(\\d+)", 1).cast("long")
    other = m.filter((n % 5 != 0) & ~((n % 5 == 1) & (F.col("seq") == 2))).withColumn("raw", F.when(n % 5 == 2, F.concat(F.lit("- "), "raw", F.lit("."))).otherwise(F.col("raw")))
    return m.filter(n % 7 != 0), other


_COMPARED = f""", m AS (SELECT paper_id, ref_seq AS seq, raw, CAST(regexp_extract(paper_id, '([0-9]+)', 1) AS BIGINT) AS n FROM mentions),
l AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY seq) AS pos, {_LOOSE.format('raw')} AS l FROM m WHERE n % 7 <> 0),
rr AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY seq) AS pos, {_LOOSE.format("CASE WHEN n % 5 = 2 THEN '- ' || raw || '.' ELSE raw END")} AS r FROM m WHERE n % 5 <> 0 AND NOT (n % 5 = 1 AND seq = 2)),
d AS (SELECT paper_id, count(l) AS n_l, count(r) AS n_r, min(CASE WHEN l IS DISTINCT FROM r THEN pos END) AS first_difference FROM l FULL JOIN rr USING (paper_id, pos) GROUP BY paper_id),
cmp AS (SELECT paper_id, CASE WHEN n_r = 0 THEN 'missing_right' WHEN n_l = 0 THEN 'missing_left' WHEN first_difference IS NULL THEN 'match' ELSE 'mismatch' END AS status, first_difference FROM d)"""


def dc10(spark, sf_dir):
    return b.compared(*_two_sources(spark, sf_dir)).withColumn("first_difference", F.col("first_difference").cast("long"))


def _citations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("citation"), (F.col("o_orderkey") % 50 + 1).alias("paper"), F.expr("concat('brand#', o_orderkey % 5 + 1, o_custkey % 5 + 1)").alias("surname"), F.expr("concat(1990 + o_custkey % 10, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE '' END)").alias("year"))


def jn12(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    refs = p.select(F.col("p_partkey").alias("ref"), F.col("p_size").cast("long").alias("paper"), F.lower("p_brand").alias("surname"), F.expr("concat(1990 + p_partkey % 10, CASE WHEN p_partkey % 4 = 0 THEN 'a' ELSE '' END)").alias("year"))
    return b.cited_references(_citations(spark, sf_dir), refs)


_JN12 = """WITH c AS (SELECT o_orderkey AS citation, o_orderkey % 50 + 1 AS paper, 'brand#' || CAST(o_orderkey % 5 + 1 AS VARCHAR) || CAST(o_custkey % 5 + 1 AS VARCHAR) AS surname, CAST(1990 + o_custkey % 10 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE '' END AS year FROM orders),
f AS (SELECT p_partkey AS ref, p_size AS paper, lower(p_brand) AS surname, CAST(1990 + p_partkey % 10 AS VARCHAR) || CASE WHEN p_partkey % 4 = 0 THEN 'a' ELSE '' END AS year FROM part),
g AS (SELECT citation, CASE WHEN c.year = f.year THEN 1 ELSE 2 END AS rung, count(DISTINCT ref) AS n_refs, min(ref) AS first_ref FROM c JOIN f ON c.paper = f.paper AND c.surname = f.surname AND substr(c.year, 1, 4) = substr(f.year, 1, 4) GROUP BY ALL)
SELECT citation, rung, n_refs, first_ref FROM g QUALIFY row_number() OVER (PARTITION BY citation ORDER BY rung) = 1"""


def _misspelt(name, at, how):
    """A name without a letter, with one more, or with another one at a place; how = 3 leaves it."""
    head, tail = F.substring(name, F.lit(1), at), F.substring(name, at + 1, F.lit(1000))
    return F.when(how == 0, F.concat(head, F.substring(tail, 2, 1000))).when(how == 1, F.concat(head, F.lit("x"), tail)).when(how == 2, F.concat(head, F.lit("q"), F.substring(tail, 2, 1000))).otherwise(name)


def _surnames(spark, sf_dir):
    """References by the names of parts, and citations of them from lines of orders, misspelt in several ways."""
    p = table(spark, sf_dir, "part").withColumn("surname", F.replace("p_name", F.lit(" "), F.lit("")))
    year = lambda c: F.concat(F.lit("199"), (c % 5).cast("string"), F.when(c % 4 == 0, "a").otherwise(""))
    refs = p.select(F.col("p_partkey").alias("ref"), (F.col("p_size") % 20).cast("long").alias("paper"), "surname", year(F.col("p_partkey")).alias("year"))
    lines = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    cited = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("citation"), (F.col("p_size") % 20).cast("long").alias("paper"), _misspelt(F.col("surname"), (F.col("l_suppkey") % 4).cast("int"), F.col("l_orderkey") % 4).alias("surname"), year(F.col("l_partkey")).alias("year"))
    return cited.distinct(), refs


def jn12_alike(spark, sf_dir):
    return b.alike_references(*_surnames(spark, sf_dir))


def _ratio_sql(pairs: str, levels: int = 6) -> str:
    """CTEs that end in ratios(a, b, ratio) over pairs(a, b): the longest common block, first in a, then in b, and the same to its left and right."""
    steps = [f"w0 AS (SELECT a, b, '' AS path, a AS x, b AS y FROM {pairs})"]
    for k in range(levels):
        steps.append(f"""m{k} AS (SELECT a, b, path, x, y, i, j, l FROM (SELECT *, unnest(range(1, least(length(x) - i, length(y) - j) + 1)) AS l FROM (SELECT *, unnest(range(length(y))) AS j FROM (SELECT *, unnest(range(length(x))) AS i FROM w{k})))
 WHERE substr(x, i + 1, l) = substr(y, j + 1, l) QUALIFY row_number() OVER (PARTITION BY a, b, path ORDER BY l DESC, i, j) = 1)""")
        steps.append(f"w{k + 1} AS (SELECT a, b, path || 'l' AS path, substr(x, 1, i) AS x, substr(y, 1, j) AS y FROM m{k} UNION ALL SELECT a, b, path || 'r', substr(x, i + l + 1), substr(y, j + l + 1) FROM m{k})")
    blocks = " UNION ALL ".join(f"SELECT a, b, l FROM m{k}" for k in range(levels))
    return ", ".join(steps) + f", ratios AS MATERIALIZED (SELECT a, b, 2.0::DOUBLE * sum(l) / (length(a) + length(b)) AS ratio FROM ({blocks}) GROUP BY a, b)"


_YEAR = "'199' || ({0} % 5) || CASE WHEN {0} % 4 = 0 THEN 'a' ELSE '' END"
_JN12_ALIKE = f"""WITH p AS (SELECT *, replace(p_name, ' ', '') AS surname FROM part), f AS (SELECT p_partkey AS ref, p_size % 20 AS paper, surname, {_YEAR.format('p_partkey')} AS year FROM p),
l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS citation, p_size % 20 AS paper, surname AS s, l_suppkey % 4 AS k, l_orderkey % 4 AS how, {_YEAR.format('l_partkey')} AS year FROM lineitem JOIN p ON l_partkey = p_partkey),
c AS (SELECT DISTINCT citation, paper, CASE how WHEN 0 THEN substr(s, 1, k) || substr(s, k + 2) WHEN 1 THEN substr(s, 1, k) || 'x' || substr(s, k + 1) WHEN 2 THEN substr(s, 1, k) || 'q' || substr(s, k + 2) ELSE s END AS surname, year FROM l),
o AS (SELECT citation, paper, surname, substr(year, 1, 4) AS base FROM c WHERE length(surname) >= 5 AND NOT EXISTS (SELECT 1 FROM f WHERE f.paper = c.paper AND f.surname = c.surname AND substr(f.year, 1, 4) = substr(c.year, 1, 4))),
met AS MATERIALIZED (SELECT DISTINCT o.paper, o.base, o.surname AS asked, f.surname AS known FROM o JOIN f ON f.paper = o.paper AND substr(f.year, 1, 4) = o.base),
pairs AS (SELECT DISTINCT known AS a, asked AS b FROM met WHERE levenshtein(known, asked) <= (length(known) + length(asked)) * 0.1 + 0.001), {_ratio_sql('pairs')},
close AS (SELECT paper, base, asked, known, row_number() OVER (PARTITION BY paper, base, asked ORDER BY ratio DESC, known DESC) AS place FROM met JOIN ratios ON a = known AND b = asked WHERE ratio >= 0.9 QUALIFY place <= 3)
SELECT citation, count(DISTINCT ref) AS n_refs, min(ref) AS first_ref, (SELECT string_agg(known, ',' ORDER BY place) FROM close z WHERE z.paper = o.paper AND z.base = o.base AND z.asked = o.surname) AS surnames
FROM o JOIN close ON close.paper = o.paper AND close.base = o.base AND asked = surname JOIN f ON f.paper = o.paper AND substr(f.year, 1, 4) = o.base AND f.surname = known GROUP BY citation, o.paper, o.base, o.surname"""


def jn13(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("concat('[', o_orderkey % 9 + 1, ', ', o_orderkey % 20 + 3, '-', o_orderkey % 20 + o_custkey % 60, ']')").alias("raw"))
    numbers = F.filter(b.expanded_numbers(F.col("raw")), lambda i: i <= 40)
    return o.select("o_orderkey", F.array_join(F.array_sort(numbers), ",").alias("refs"))


_JN13 = """SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_concat([o_orderkey % 9 + 1], CASE WHEN o_custkey % 60 - 3 BETWEEN 0 AND 50 THEN range(o_orderkey % 20 + 3, o_orderkey % 20 + o_custkey % 60 + 1) ELSE [] END), lambda i: i <= 40))), ',') AS refs FROM orders"""


def jn14(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return b.as_of(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id")).select("event_id", F.col("at").alias("section"))


def jn15(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    at = (F.char_length("text") / 2).cast("int")
    return d.select("doc_id", b.line_number(F.col("text"), at).cast("long").alias("line"))


def jn16(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.coalesce("value", F.lit(0.0)) * 1000) * 1_000_000).alias("end"))
    return b.outside_earlier_spans(e, "user_id", "start", "end", "event_id").select("event_id")


_JN16 = """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(coalesce(value, 0) * 1000) AS BIGINT) * 1000000 AS t FROM events)
SELECT event_id FROM e m WHERE NOT EXISTS (SELECT 1 FROM e l WHERE l.user_id = m.user_id AND (l.s < m.s OR l.s = m.s AND l.event_id < m.event_id) AND m.s < l.t)"""


def jn17(spark, sf_dir):
    h = a.blocks(spark, sf_dir).select("doc", "idx", (F.pmod(F.col("idx") * 7 + F.col("doc"), F.lit(4)) + 1).alias("level"))
    return b.section_bounds(h, "doc", "idx", "level").select("doc", "idx", "end_pos", "parent_pos")


_JN17 = ", h AS (SELECT doc, idx, (idx * 7 + doc) % 4 + 1 AS level FROM blocks) SELECT doc, idx, (SELECT min(n.idx) FROM h n WHERE n.doc = h.doc AND n.idx > h.idx AND n.level <= h.level) AS end_pos, (SELECT max(n.idx) FROM h n WHERE n.doc = h.doc AND n.idx < h.idx AND n.level < h.level) AS parent_pos FROM h"

_JN18 = """, i AS (SELECT doc AS d, idx AS parent, x0 AS a0, y0 AS b0, x1 AS a1, y1 AS b1 FROM blocks WHERE type = 'image'),
m AS (SELECT doc, idx, parent, round((greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0))) / ((x1 - x0) * (y1 - y0)), 6) AS share, round((a1 - a0) * (b1 - b0), 6) AS area FROM blocks JOIN i ON doc = d AND idx <> parent)
SELECT doc, idx, parent FROM m WHERE share >= 0.9 QUALIFY row_number() OVER (PARTITION BY doc, idx ORDER BY share DESC, area, parent) = 1"""


def dc8(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    own = F.split("text", "\n")
    head = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("# References"))).otherwise(F.array(F.lit("plain line")))
    tail = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("# Appendix"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.slice(own, 1, 2), head, F.slice(own, 3, 2), tail, F.slice(own, 5, F.greatest(F.size(own), F.lit(1))))
    found = b.reference_lines(lines)
    return d.select("doc_id", F.size(found).cast("long").alias("n_lines"), F.md5(F.array_join(found, "\n")).alias("md5"))


_DC8 = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS o FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN [] WHEN doc_id % 2 = 0 THEN o[3:4] ELSE o[3:] END AS l FROM d)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, md5(array_to_string(l, chr(10))) AS md5 FROM f"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def sk2(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changed = base.filter("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("CHANGED")).unionByName(base.filter("c_custkey % 50 = 1").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    return r.replaced(base, changed, "c_custkey")


def jn11(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey")
    of = lambda cond, word: table(spark, sf_dir, "customer").filter(cond).select("c_custkey", F.concat(F.lit(word), "c_name").alias("v"))
    return r.overridden(base, of("c_custkey % 3 = 0", "repaired "), of("c_custkey % 2 = 0", "verified "), key="c_custkey", value="v")


def sk5(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    now = p.select("p_partkey", F.sha1(F.concat_ws("\n", "p_name", "p_type")).alias("print"))
    old = p.filter("p_partkey % 9 <> 0").select("p_partkey", F.sha1(F.concat_ws("\n", "p_name", F.when(F.col("p_size") > 40, F.lit("old")).otherwise(F.col("p_type")))).alias("print"))
    return r.stale(now, old, "p_partkey", "print")


def tk8(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.floor(F.col("o_totalprice"))).cast("long").alias("size"))
    return r.within_budget(o, "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], "size", 500_000).select("o_orderkey", "used")


def pf16(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN NULL ELSE l_quantity > 5 END").alias("v"))
    return r.conjunction(i, ["l_orderkey"], "v")


def pf17(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", r.same_version(F.expr("CASE p_partkey % 3 WHEN 0 THEN 'V1.2' WHEN 1 THEN 'v2' END"), F.expr("CASE p_partkey % 2 WHEN 0 THEN ' 1.2' ELSE '2' END")).alias("same"))


_KINDS = {"Entity": ("Paper", "Dataset", "Split", "Code", "Model", "Benchmark"), "Concept": ("Method", "Task", "Metric", "Protocol", "Issue", "Proposition")}


def pf2(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    batch = p.select(
        F.expr("concat('r', p_partkey - CASE WHEN p_partkey % 100 = 7 THEN 1 ELSE 0 END)").alias("ref"),
        F.expr("CASE WHEN p_partkey % 90 = 0 THEN 'Content' WHEN p_partkey % 2 = 0 THEN 'Entity' ELSE 'Concept' END").alias("family"),
        F.expr("CASE WHEN p_partkey % 80 = 1 THEN 'Model' WHEN p_partkey % 2 = 0 THEN 'Model' ELSE 'Method' END").alias("kind"),
        F.expr("CASE WHEN p_partkey % 70 = 0 THEN ' ' WHEN p_partkey % 60 = 0 THEN concat(p_name, '|x') ELSE p_name END").alias("name"),
        F.expr("array(concat('url:', p_brand), concat(CASE WHEN p_partkey % 50 = 0 THEN 'isbn' ELSE 's2' END, ':', p_partkey - CASE WHEN p_partkey % 40 = 1 THEN 1 ELSE 0 END))").alias("identifiers"),
    )
    return r.violations(batch, _KINDS, ("arxiv", "doi", "s2", "url"))


_PF2 = """WITH n AS (SELECT 'r' || CAST(p_partkey - CASE WHEN p_partkey % 100 = 7 THEN 1 ELSE 0 END AS VARCHAR) AS ref, CASE WHEN p_partkey % 90 = 0 THEN 'Content' WHEN p_partkey % 2 = 0 THEN 'Entity' ELSE 'Concept' END AS family,
 CASE WHEN p_partkey % 80 = 1 THEN 'Model' WHEN p_partkey % 2 = 0 THEN 'Model' ELSE 'Method' END AS kind, CASE WHEN p_partkey % 70 = 0 THEN ' ' WHEN p_partkey % 60 = 0 THEN p_name || '|x' ELSE p_name END AS name,
 CASE WHEN p_partkey % 50 = 0 THEN 'isbn' ELSE 's2' END AS ns, p_partkey - CASE WHEN p_partkey % 40 = 1 THEN 1 ELSE 0 END AS num FROM part)
SELECT DISTINCT * FROM (SELECT ref, 'kind-not-allowed' AS rule FROM n WHERE NOT (family = 'Entity' AND kind = 'Model' OR family = 'Concept' AND kind = 'Method') UNION ALL SELECT ref, 'name-missing' FROM n WHERE trim(name) = '' UNION ALL SELECT ref, 'bar-in-name' FROM n WHERE contains(name, '|')
 UNION ALL SELECT ref, 'unknown-namespace' FROM n WHERE ns = 'isbn' UNION ALL SELECT ref, 'duplicate-ref' FROM n GROUP BY ref HAVING count(*) > 1
 UNION ALL SELECT ref, 'duplicate-identifier' FROM n WHERE (ns, num) IN (SELECT (ns, num) FROM n GROUP BY ns, num HAVING count(DISTINCT ref) > 1))"""


def jn30(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"))
    rule = F.expr("CASE WHEN pos.l_partkey % 11 = 0 THEN 1 WHEN pos.l_suppkey % 5 = 0 THEN 2 WHEN pos.l_partkey % 2 = 0 THEN 3 END")
    return r.best_tier(i, "l_orderkey", rule, "pos").select("l_orderkey", "tier", F.col("pos.l_partkey").alias("l_partkey"))


def ag12(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    rule = docs.filter("doc_id % 4 <> 0").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("ours"))
    return r.agreement(labels.join(rule, "doc_id", "left"), "ours", "quality")


def ag13(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    bucket = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("n_chars") < 300), "short").when(F.col("quality") == 1, "good").otherwise("other")
    return d.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def ag25(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return e.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def wn10(spark, sf_dir):
    """The first document of each text, without a sort: the least id is the first seen."""
    return table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"))


QUERIES = {
    "ag1_reference_index": (lambda s, d: b.reference_index(a.mentions(s, d)), oracle("mentions", _KEYED + " SELECT * FROM idx")),
    "ag2_top_years": (_top("year", 3), _top_sql("year", 3)),
    "ag3_representative_title": (_top("title", 1), _top_sql("title", 1)),
    "ag5_index_summary": (lambda s, d: b.index_summary(b.reference_index(a.mentions(s, d))), oracle("mentions", _KEYED + " SELECT CAST(sum(mention_count) AS BIGINT) AS n_mentions, count(*) AS n_keys, count(*) FILTER (citing_paper_count > 1) AS n_repeated, count(*) FILTER (key_type = 'title') AS n_titles FROM idx")),
    "ag6_extraction_summary": (lambda s, d: a.mentions(s, d).agg(F.countDistinct("paper_id").alias("n_papers"), F.count(F.lit(1)).alias("n_references"), F.count_if(F.col("confidence") == "low").alias("n_low")), oracle("mentions", " SELECT count(DISTINCT paper_id) AS n_papers, count(*) AS n_references, count(*) FILTER (confidence = 'low') AS n_low FROM mentions")),
    "ag7_compare_summary": (lambda s, d: b.compared(*_two_sources(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n")), oracle("mentions", _COMPARED + " SELECT status, count(*) AS n FROM cmp GROUP BY status")),
    "dc10_compare_sources": (dc10, oracle("mentions", _COMPARED + " SELECT * FROM cmp")),
    "wn8_first_difference": (lambda s, d: dc10(s, d).filter("status = 'mismatch'").select("paper_id", "first_difference"), oracle("mentions", _COMPARED + " SELECT paper_id, first_difference FROM cmp WHERE status = 'mismatch'")),
    "tk4_index_sort": (tk4, oracle("mentions", _KEYED + " SELECT key, key_type, mention_count FROM idx ORDER BY mention_count DESC, key_type, key")),
    "jn12_citation_lookup": (jn12, _JN12),
    "jn12_alike_surnames": (jn12_alike, _JN12_ALIKE),
    "jn13_numeric_citations": (jn13, _JN13),
    "jn14_as_of_section": (jn14, "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events"),
    "jn15_line_of_offset": (jn15, "SELECT doc_id, CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS BIGINT) AS line FROM (SELECT doc_id, substr(text, 1, CAST(floor(length(text) / 2) AS INTEGER)) AS p FROM documents WHERE text IS NOT NULL)"),
    "jn16_span_anti_overlap": (jn16, _JN16),
    "jn17_section_bounds": (jn17, oracle("blocks", _JN17)),
    "jn18_box_containment": (lambda s, d: b.containers(a.blocks(s, d)), oracle("blocks", _JN18)),
    "wn6_merged_runs": (lambda s, d: b.merged_runs(a.blocks(s, d)), oracle("blocks", ", x AS (SELECT *, sum(CASE WHEN merge_prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY idx) AS run FROM blocks) SELECT doc, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM x GROUP BY doc, run")),
    "wn10_first_occurrence": (wn10, "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text"),
    "dc8_reference_section": (dc8, _DC8),
    "ag27_block_types": (lambda s, d: a.blocks(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")), oracle("blocks", " SELECT type, count(*) AS n FROM blocks GROUP BY type")),
    "ag12_agreement": (ag12, "SELECT count(*) AS n, count(ours) AS matched, count(*) FILTER (ours = quality) AS agree, round(count(ours) / nullif(count(*), 0), 3) AS recall FROM labels LEFT JOIN (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS ours FROM documents WHERE doc_id % 4 <> 0) USING (doc_id)"),
    "ag13_adjudicated_buckets": (ag13, "SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 AND n_chars < 300 THEN 'short' WHEN quality = 1 THEN 'good' ELSE 'other' END AS bucket, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY bucket"),
    "ag25_usage_totals": (ag25, "SELECT event_type, key, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.' || key) AS BIGINT)) AS BIGINT) AS total FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL"),
    "sk2_replace_record": (sk2, "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, c_name, c_mktsegment FROM customer WHERE c_custkey % 50 = 1"),
    "sk4_latest_per_key": (lambda s, d: r.latest(_events(s, d).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type"), "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "sk5_stale_embeddings": (sk5, "SELECT p_partkey, sha1(p_name || chr(10) || p_type) AS print FROM part WHERE p_partkey % 9 = 0 OR p_size > 40"),
    "jn11_merge_repairs": (jn11, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'repaired ' ELSE 'verified ' END || c_name AS v, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS source FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0"),
    "tk8_cache_budget": (tk8, "SELECT o_orderkey, CAST(used AS BIGINT) AS used FROM (SELECT o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders) WHERE used <= 500000"),
    "pf2_seed_violations": (pf2, _PF2),
    "pf16_three_valued": (pf16, "WITH i AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN NULL ELSE l_quantity > 5 END AS v FROM lineitem) SELECT l_orderkey, CASE WHEN count(*) FILTER (NOT v) > 0 THEN false WHEN count(*) FILTER (v) = count(*) THEN true END AS value FROM i GROUP BY l_orderkey"),
    "pf17_same_version": (pf17, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 OR p_partkey % 3 = 1 AND p_partkey % 2 = 1 THEN true END AS same FROM part"),
    "jn30_first_by_tier": (jn30, "WITH i AS (SELECT *, CASE WHEN l_partkey % 11 = 0 THEN 1 WHEN l_suppkey % 5 = 0 THEN 2 WHEN l_partkey % 2 = 0 THEN 3 END AS tier FROM lineitem) SELECT l_orderkey, tier, l_partkey FROM i WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1"),
}
