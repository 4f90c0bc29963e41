"""Queries of anchors, rule tables, citation contexts and discovery, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as t
from quillmesh.operators import anchors as n
from quillmesh.operators import records as r
from quillmesh.plans.report_queries import _rows
from quillmesh.plans.text_queries import _NORM_URL, _pages
from quillmesh.session import table

_ANCHOR = "CASE o_orderkey % 6 WHEN 1 THEN concat('p', o_custkey, '#s1') WHEN 2 THEN concat('q', o_custkey, '#s1:11-12') WHEN 3 THEN concat('p', o_custkey, '#s2:11-12') WHEN 4 THEN concat('p', o_custkey, '#s1:19-', 18 + o_orderkey % 4) ELSE concat('p', o_custkey, '#s1:10-20') END"


def pf5(spark, sf_dir):
    sections = _rows("customer", "concat('p', c_custkey) AS paper", "'s1' AS section", "10 AS first", "20 AS last")(spark, sf_dir)
    return n.anchor_issues(_rows("orders", "o_orderkey", f"{_ANCHOR} AS anchor")(spark, sf_dir), sections)


def ac11(spark, sf_dir):
    return _rows("orders", "o_orderkey", f"{_ANCHOR} AS anchor")(spark, sf_dir).select("o_orderkey", n.parsed_anchor(F.col("anchor")).alias("p")).select("o_orderkey", "p.*")


_LABELS = {"Paper": (["title"], ["year"]), "Claim": (["text", "kind"], []), "Resource": (["name"], ["url"])}
_PROPS = "map('title', p_name, 'name', CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'n' END)"


def pf3(spark, sf_dir):
    nodes = _rows("part", "p_partkey AS ref", "CASE p_partkey % 4 WHEN 0 THEN 'Paper' WHEN 1 THEN 'Claim' WHEN 2 THEN 'Resource' ELSE 'Ghost' END AS label", f"CASE WHEN p_partkey % 5 = 0 THEN map('title', p_name) ELSE {_PROPS} END AS props")(spark, sf_dir)
    return n.node_violations(nodes, _LABELS)


_PF3 = """SELECT p_partkey AS ref, 'unknown-label' AS rule FROM part WHERE p_partkey % 4 = 3 UNION ALL SELECT p_partkey, 'missing-property' FROM part WHERE p_partkey % 4 = 1 OR p_partkey % 4 = 2 AND (p_partkey % 5 = 0 OR p_partkey % 3 = 0)
UNION ALL SELECT p_partkey, 'unknown-property' FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 5 <> 0 OR p_partkey % 4 IN (1, 2)"""
_REL = ("l_orderkey * 10 + l_linenumber AS ref", "CASE l_linenumber % 3 WHEN 0 THEN 'USES' WHEN 1 THEN 'CITES' ELSE 'LIKES' END AS type", "'Paper' AS src", "CASE WHEN l_suppkey % 2 = 0 THEN 'Paper' ELSE 'Resource' END AS dst", "CASE l_returnflag WHEN 'A' THEN 'tooling' WHEN 'N' THEN 'fun' END AS role")


def pf4(spark, sf_dir):
    return n.rel_violations(_rows("lineitem", *_REL)(spark, sf_dir), [("USES", "Paper", "Resource"), ("CITES", "Paper", "Paper")], {"USES": ["tooling"]})


_PF4 = f"""WITH r AS (SELECT {', '.join(_REL)} FROM lineitem) SELECT ref, 'unknown-type' AS rule FROM r WHERE type = 'LIKES' UNION ALL SELECT ref, 'ends-not-allowed' FROM r WHERE type = 'USES' AND dst = 'Paper' OR type = 'CITES' AND dst = 'Resource'
UNION ALL SELECT ref, 'role-missing' FROM r WHERE type = 'USES' AND role IS NULL UNION ALL SELECT ref, 'role-unknown' FROM r WHERE type = 'USES' AND role = 'fun' UNION ALL SELECT ref, 'role-not-asked' FROM r WHERE type = 'CITES' AND role IS NOT NULL"""
_RECORD = ("CASE p_partkey % 7 WHEN 1 THEN concat('Data::', p_partkey) WHEN 2 THEN concat('data::x', p_partkey - 1) WHEN 3 THEN concat('data::x', p_partkey - 2) ELSE concat('code::y-', p_partkey) END AS id", "CASE WHEN p_partkey % 11 = 0 THEN 'thing' ELSE 'data' END AS kind", "CASE p_partkey % 5 WHEN 0 THEN 'mentions' WHEN 1 THEN 'likes' ELSE 'uses' END AS relation", "CASE WHEN p_partkey % 3 = 0 THEN p_name END AS evidence")
_PF6 = f"""WITH r AS (SELECT p_partkey AS k, {', '.join(_RECORD)} FROM part) SELECT DISTINCT * FROM (SELECT id, 'form' AS rule FROM r WHERE k % 7 = 1 UNION ALL SELECT id, 'kind' FROM r WHERE kind = 'thing' UNION ALL SELECT id, 'relation' FROM r WHERE relation = 'likes'
UNION ALL SELECT id, 'evidence-missing' FROM r WHERE relation <> 'mentions' AND evidence IS NULL UNION ALL SELECT id, 'repeated' FROM r GROUP BY id HAVING count(*) > 1)"""


def pf11(spark, sf_dir):
    s = _pages(spark, sf_dir).withColumn("kind", F.expr("CASE page_id % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'Code' ELSE 'code' END"))
    found = n.normalized_resource(F.col("kind"), F.concat(F.lit("My Name, No. "), "page_id"), F.col("s"), ["dataset", "code"])
    return s.select("page_id", found.alias("r")).select("page_id", "r.*")


def _lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "s"))
    return d.select("doc_id", "pos", F.expr("concat(repeat(' ', cast((pos * (doc_id % 4 + 1)) % 6 AS INT)), ltrim(' ', s))").alias("line"))


_WN13 = """WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, pos, CASE WHEN ltrim(s, ' ') = '' AND false THEN 0 ELSE (pos * (doc_id % 4 + 1)) % 6 END AS width FROM x),
u AS (SELECT *, min(CASE WHEN width > 0 THEN width END) OVER (PARTITION BY doc_id) AS unit FROM w) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(coalesce(round_even(width / unit, 0), 0) AS BIGINT) AS level FROM u"""
_SPAN = "coalesce(text, '') AS t, CAST((doc_id * 37) % greatest(length(coalesce(text, '')), 1) AS INT) AS a, CAST((doc_id * 37) % greatest(length(coalesce(text, '')), 1) + 5 + (doc_id % 3) * 50 AS INT) AS b"


def st15(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", *[x for x in _SPAN.replace(", CAST", "| CAST").split("|")])
    return d.select("doc_id", F.md5(n.sentence_at(F.col("t"), F.col("a"), F.col("b"))).alias("md5"))


_ST15 = f"""WITH d AS (SELECT doc_id, {_SPAN} FROM documents), q AS (SELECT *, string_split(regexp_replace(t, '([.!?])(\\s+)([A-Z0-9#])', '\\1\\2' || chr(1) || '\\3', 'g'), chr(1)) AS ps FROM d),
x AS (SELECT doc_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS i FROM q), e AS (SELECT doc_id, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) - length(s) AS lo, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS hi FROM x),
f AS (SELECT d.doc_id, any_value(t) AS t, any_value(b) AS b, coalesce(max(lo), 0) AS lo, coalesce(max(hi), any_value(length(t))) AS hi FROM d LEFT JOIN e ON d.doc_id = e.doc_id AND lo <= a AND a < hi GROUP BY d.doc_id),
z AS (SELECT doc_id, t, CAST(lo AS BIGINT) AS lo, CAST(CASE WHEN b > hi THEN least(length(t), b + 240) ELSE hi END AS BIGINT) AS hi FROM f)
SELECT doc_id, md5(trim(regexp_replace(substr(t, lo + 1, hi - lo), '[\\t-\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))) AS md5 FROM z"""


def st32(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return n.plain_contexts(d, "doc_id", "text", "[A-Z][a-z]+ing").withColumn("context", F.md5("context"))


_ST32 = """WITH x AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS s, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, md5(s) AS context FROM x WHERE length(s) >= 40 AND regexp_matches(s, '[A-Z][a-z]+ing') QUALIFY n <= 100"""


def dc16(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper"))
    source = lambda name, m: part.filter(F.col("paper") % m == 0).withColumn("input", F.concat(F.lit(f"{name} "), "paper"))
    return r.overridden(part, source("verified", 7), source("built", 5), source("repaired", 3), source("degraded", 2), key="paper", value="input").withColumn("source", F.col("source").cast("long"))


_DC16 = "SELECT p_partkey AS paper, CASE WHEN p_partkey % 7 = 0 THEN 'verified ' WHEN p_partkey % 5 = 0 THEN 'built ' WHEN p_partkey % 3 = 0 THEN 'repaired ' ELSE 'degraded ' END || p_partkey AS input, CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 3 = 0 THEN 2 ELSE 3 END AS BIGINT) AS source FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR p_partkey % 3 = 0 OR p_partkey % 2 = 0"
_PATH = "CASE p_partkey % 4 WHEN 0 THEN concat('acl/2025/long/2025.acl-long.', p_partkey, '.pdf') WHEN 1 THEN concat('emnlp/2024/main/2024.emnlp-main.', p_partkey, '.pdf') WHEN 2 THEN 'acl/2025/long/2025.acl-long.pdf' ELSE concat('tmp/', p_partkey, '.txt') END"
_SC5 = "SELECT CASE WHEN p_partkey % 4 = 0 THEN '2025.acl-long.' ELSE '2024.emnlp-main.' END || p_partkey AS paper, CASE WHEN p_partkey % 4 = 0 THEN 'acl' ELSE 'emnlp' END AS top, CASE WHEN p_partkey % 4 = 0 THEN '2025' ELSE '2024' END AS year, CASE WHEN p_partkey % 4 = 0 THEN 'long' ELSE 'main' END AS kind, " + _PATH + " AS path FROM part WHERE p_partkey % 4 IN (0, 1)"


def ag22(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.countDistinct("o_custkey").alias("collections"), F.count(F.lit(1)).alias("papers"), *[F.count_if(F.col("o_orderstatus") == k).alias(f"n_{k.lower()}") for k in "FOP"])


QUERIES = {
    "pf5_anchor_issues": (pf5, f"SELECT o_orderkey, {_ANCHOR} AS anchor, CASE WHEN o_orderkey % 6 = 1 THEN 'form' WHEN o_orderkey % 6 = 2 OR c_custkey IS NULL THEN 'paper' WHEN o_orderkey % 6 = 3 THEN 'section' WHEN o_orderkey % 6 = 4 AND (18 + o_orderkey % 4 < 19 OR 18 + o_orderkey % 4 > 20) THEN 'lines' END AS issue FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "ac11_parsed_anchor": (ac11, f"WITH a AS (SELECT o_orderkey, {_ANCHOR} AS x, o_orderkey % 6 <> 1 AS ok FROM orders) SELECT o_orderkey, CASE WHEN ok THEN split_part(x, '#', 1) END AS paper, CASE WHEN ok THEN split_part(split_part(x, '#', 2), ':', 1) END AS section, CASE WHEN ok THEN CAST(split_part(split_part(x, ':', 2), '-', 1) AS BIGINT) END AS first, CASE WHEN ok THEN CAST(split_part(x, '-', 2) AS BIGINT) END AS last FROM a"),
    "ac10_read_lines": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(n.read_lines(F.col("text"), F.lit(2), F.lit(4))).alias("md5")), "SELECT doc_id, md5(coalesce(array_to_string(string_split(coalesce(text, ''), chr(10))[2:4], chr(10)), '')) AS md5 FROM documents"),
    "pf3_node_rules": (pf3, _PF3),
    "pf4_relation_rules": (pf4, _PF4),
    "pf6_resource_issues": (lambda s, d: n.resource_issues(_rows("part", *_RECORD)(s, d), ["data", "code"], ["uses", "mentions"]), _PF6),
    "pf11_normalized_resource": (pf11, f"WITH {_NORM_URL} SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'other' ELSE 'code' END AS kind, CASE page_id % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'other' ELSE 'code' END || '::my-name-no-' || page_id AS id, v AS url FROM m"),
    "st15_sentence": (st15, _ST15),
    "st32_plain_contexts": (st32, _ST32),
    "wn13_indentation": (lambda s, d: n.indentation(_lines(s, d), "doc_id", "line").select("doc_id", "pos", "level"), _WN13),
    "dc16_input_ladder": (dc16, _DC16),
    "sc5_discovered_papers": (lambda s, d: n.discovered(_rows("part", f"{_PATH} AS path")(s, d), "path"), _SC5),
    "ag22_year_summary": (ag22, "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(DISTINCT o_custkey) AS collections, count(*) AS papers, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY ALL"),
}
