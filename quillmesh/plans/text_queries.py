"""Queries of the text functions over names, document lines and page addresses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import json_text as js
from quillmesh.functions import text as t
from quillmesh.session import table
from quillmesh.sources import adapters as a
from quillmesh.sources.adapters import oracle

_TITLED = """CASE WHEN doc_id % 3 = 0 THEN '“' || coalesce(text, '') || '” – R&D re- view' ELSE coalesce(text, '') || ' multi- modal' END"""


def _titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_TITLED).alias("s"))


def _of(value, source=_titles, key="doc_id", name="v"):
    return lambda spark, sf_dir: source(spark, sf_dir).select(key, value(F.col("s")).alias(name))


def _pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.expr("CASE page_id % 6 WHEN 0 THEN url || '/?utm_source=x&q=' || page_id WHEN 1 THEN 'GitHub.com/org' || page_id || '/repo.git' WHEN 2 THEN 'https://huggingface.co/datasets/o/d' || page_id WHEN 3 THEN 'https://arxiv.org/abs/2501.' || lpad(page_id % 100000, 5, '0') || 'v2' WHEN 4 THEN 'https://hf.co/org/m' || page_id || '#f' ELSE url || '.pdf).' END").alias("s"))


_PAGES = "p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '/?utm_source=x&q=' || page_id WHEN 1 THEN 'GitHub.com/org' || page_id || '/repo.git' WHEN 2 THEN 'https://huggingface.co/datasets/o/d' || page_id WHEN 3 THEN 'https://arxiv.org/abs/2501.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') || 'v2' WHEN 4 THEN 'https://hf.co/org/m' || page_id || '#f' ELSE url || '.pdf).' END AS s FROM pages)"
_Q = f"q AS (SELECT doc_id, {_TITLED} AS s FROM documents)"
_SCHEME = "CASE WHEN contains(s, '://') THEN s ELSE 'https://' || s END"
_HOST = "lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_NORM_URL = f"""{_PAGES}, n AS (SELECT page_id, s, CASE WHEN contains(z, '://') THEN z ELSE 'https://' || z END AS u FROM (SELECT page_id, s, rtrim(trim(s), '.,;:!?)]}}') AS z FROM p)),
 m AS (SELECT page_id, s, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {_HOST} || rtrim({_PATH}, '/') || CASE WHEN k = '' THEN '' ELSE '?' || k END AS v
 FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda x: contains(x, '=') AND NOT lower(split_part(x, '=', 1)) IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref')), '&') AS k FROM n))"""
_SPACED = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'))"
_PLAIN = "trim(regexp_replace(regexp_replace({}, '\\\\([_*#])', '\\1', 'g'), '[\\t-\\r ]+', ' ', 'g'))"
_WS_SQL = "trim(regexp_replace(nfc_normalize({}), '[\\t-\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


def _refs(spark, sf_dir):
    """Reference-like lines: authors, a year, a title and identifiers, made from the rows of part."""
    p = table(spark, sf_dir, "part")
    line = "p_brand || ', A. and ' || p_type || '. ' || CAST(1950 + p_partkey % 75 AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE '' END || '. ' || p_name || '. In Proceedings of X, doi 10.1234/ab.' || CAST(p_partkey AS STRING) || ', arXiv:2001.' || lpad(CAST(p_partkey % 100000 AS STRING), 5, '0') || ' https://ex.org/' || CAST(p_partkey AS STRING) || '.'"
    return p.select("p_partkey", F.expr(f"CASE WHEN p_partkey % 7 = 0 THEN p_name || ' no year here' ELSE {line} END").alias("s"))


_REFS = "r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' no year here' ELSE p_brand || ', A. and ' || p_type || '. ' || CAST(1950 + p_partkey % 75 AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE '' END || '. ' || p_name || '. In Proceedings of X, doi 10.1234/ab.' || CAST(p_partkey AS VARCHAR) || ', arXiv:2001.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') || ' https://ex.org/' || CAST(p_partkey AS VARCHAR) || '.' END AS s FROM part)"


def st9(spark, sf_dir):
    r = t.parse_reference(F.col("s"))
    one = _refs(spark, sf_dir).select("p_partkey", r.alias("r"))
    join = lambda c: F.array_join(f"r.{c}", "|").alias(c)
    return one.select("p_partkey", "r.authors", "r.year", "r.title", join("arxiv_ids"), join("dois"), join("urls"), "r.confidence", join("warnings"))


_ST9 = f"""WITH {_REFS}, y AS (SELECT *, regexp_extract(s, '\\b((?:18|19|20)[0-9]{{2}}[a-z]?)\\b', 1) AS year FROM r),
z AS (SELECT *, CASE WHEN year = '' THEN '' ELSE trim(substr(s, 1, instr(s, year) - 1), ' .,:;') END AS authors, CASE WHEN year = '' THEN '' ELSE trim(substr(s, instr(s, year) + length(year)), ' .,:;') END AS rest FROM y),
w AS (SELECT *, CASE WHEN rest = '' THEN '' WHEN instr(rest, '. In ') > 1 THEN trim(substr(rest, 1, instr(rest, '. In ') - 1), ' .') ELSE trim(split_part(rest, '. ', 1), ' .') END AS title FROM z)
SELECT p_partkey, authors, year, title, array_to_string(list_sort(list_distinct(regexp_extract_all(s, '(?i)\\barXiv\\s*:?\\s*([0-9]{{4}}\\.[0-9]{{4,5}}(?:v[0-9]+)?)\\b', 1))), '|') AS arxiv_ids,
array_to_string(list_transform(regexp_extract_all(s, '\\b10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+\\b'), lambda x: rtrim(x, '.')), '|') AS dois, array_to_string(list_transform(regexp_extract_all(s, 'https?://[^\\s,;)>\\]]+'), lambda x: rtrim(x, '.')), '|') AS urls,
CASE WHEN year = '' OR title = '' THEN 'low' ELSE 'high' END AS confidence, concat_ws('|', CASE WHEN year = '' THEN 'no_year' END, CASE WHEN authors = '' THEN 'no_authors' END, CASE WHEN title = '' THEN 'no_title' END) AS warnings FROM w"""


def st13(spark, sf_dir):
    r = _refs(spark, sf_dir).select("p_partkey", t.parse_reference(F.col("s")).alias("r"))
    return r.select("p_partkey", t.first_author(F.col("r.authors")).alias("surname"), t.base_year(F.col("r.year")).alias("base_year"), t.has_year_suffix(F.col("r.year")).alias("suffixed"))


def st12(spark, sf_dir):
    return _refs(spark, sf_dir).select("p_partkey", t.looks_like_start(F.col("s")).alias("starts"), t.looks_like_authors(F.col("s")).alias("authors"), t.looks_complete(F.col("s")).alias("complete"))


def st18(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(t.url_mentions(F.concat_ws(" and ", "url", F.lit("(https://a.b/c)."), "url", F.lit("http://x.y/z]"))), " ").alias("urls"))


def st11(spark, sf_dir):
    s = F.expr("CASE o_orderkey % 8 WHEN 0 THEN '# References' WHEN 1 THEN '7. Works Cited:' WHEN 2 THEN 'Bibliography.' WHEN 3 THEN 'REFERENCE' WHEN 4 THEN 'References used' WHEN 5 THEN '7.1 references' WHEN 6 THEN 'Preferences' ELSE o_orderpriority END")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.is_reference_heading(s).alias("is_heading"))


def st25(spark, sf_dir):
    s = F.expr("CASE page_id % 5 WHEN 0 THEN '2501.' || lpad(page_id % 100000, 5, '0') || 'v1' WHEN 1 THEN 'https://arxiv.org/pdf/2501.' || lpad(page_id % 100000, 5, '0') || 'v3.pdf' WHEN 2 THEN 'cs/9901001v2' WHEN 3 THEN 'https://example.org/abs/2501.00001' ELSE 'https://arxiv.org/abs/2501.' || lpad(page_id % 100000, 5, '0') END")
    return table(spark, sf_dir, "pages").select("page_id", t.arxiv_id(s).alias("r")).select("page_id", "r.id", "r.version")


_ST25 = """SELECT page_id, CASE page_id % 5 WHEN 2 THEN 'cs/9901001' WHEN 3 THEN NULL ELSE '2501.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') END AS id, CASE page_id % 5 WHEN 0 THEN 'v1' WHEN 1 THEN 'v3' WHEN 2 THEN 'v2' END AS version FROM pages"""


def st34(spark, sf_dir):
    s = F.expr("CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'Ann B. Lee' WHEN 2 THEN 'ann@x.org' WHEN 3 THEN 'We thank all. This paper is good' ELSE repeat('Ab ', 9) END")
    return table(spark, sf_dir, "customer").select("c_custkey", t.good_author(s).alias("good"))


def ma1(spark, sf_dir):
    b = a.blocks(spark, sf_dir)
    box = ("x0", "y0", "x1", "y1")
    fixed = tuple(F.lit(x) for x in (0.1, 0.1, 0.4, 0.4))
    return b.select("doc", "idx", F.round(t.box_area(*[F.col(c) for c in box]), 9).alias("area"), F.round(t.box_overlap(tuple(F.col(c) for c in box), fixed), 9).alias("overlap"))


def rt10(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = t.embedding_text(F.col("p_name"), F.when(F.col("p_size") > 25, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")), F.col("p_type"), F.lit(""))
    return p.select("p_partkey", text.alias("text"), t.embedding_key(F.lit("model-1"), text).alias("embedding_key"))


def ha1_payload(spark, sf_dir):
    """Orders as payloads with a list, a map and nulls; their fields are named out of order."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "named_struct('z', CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END, 'key', o_orderkey, 'm', map('b', o_orderkey % 2 = 0, 'a', true), 'A', transform(sequence(1, 1 + int(o_custkey % 3)), i -> concat(o_orderstatus, '\"', i))) AS p")
    return o.select("o_orderkey", js.payload_hash(F.col("p"), o.schema["p"].dataType).alias("hash"))


_HA1_PAYLOAD = """SELECT o_orderkey, sha256('{"A": [' || array_to_string(list_transform(range(1, 2 + o_custkey % 3), lambda i: '"' || o_orderstatus || '\\"' || i || '"'), ', ') || '], "key": ' || o_orderkey || ', "m": {"a": true, "b": ' || (o_orderkey % 2 = 0) || '}, "z": ' || CASE WHEN o_custkey % 3 > 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || '}') AS hash FROM orders"""

QUERIES = {
    "st1_name_normalize": (_of(lambda s: t.normalize_name(F.concat(F.lit("  A\u00a0e\u0301  "), s, F.lit("\u3000")))), f"WITH {_Q} SELECT doc_id, {_WS_SQL.format('(chr(32) || chr(32) || chr(65) || chr(160) || chr(101) || chr(769) || chr(32) || chr(32) || s || chr(12288))')} AS v FROM q"),
    "st2_name_key": (_of(lambda s: t.name_key(s, F.lit("Method"), F.lit("global"))), f"WITH {_Q} SELECT doc_id, {_WS_SQL.format('s')} || '|Method|global' AS v FROM q"),
    "st3_loose_normalize": (_of(t.loose), f"WITH {_Q} SELECT doc_id, regexp_replace(lower(s), '[^a-z0-9]', '', 'g') AS v FROM q"),
    "st5_canonical_title": (_of(t.canonical_title), f"WITH {_Q} SELECT doc_id, " + _SPACED.format("replace(lower(translate(regexp_replace(trim(s), '([A-Za-z])-\\s+([a-z])', '\\1\\2', 'g'), '“”’–—', '\"\"''--')), '&', ' and ')") + " AS v FROM q"),
    "st6_canonical_raw": (_of(t.canonical_raw), f"WITH {_Q} SELECT doc_id, " + _SPACED.format("regexp_replace(lower(trim(s)), '([a-z])-\\s+([a-z])', '\\1\\2', 'g')") + " AS v FROM q"),
    "st7_canonical_reference": (_of(lambda s: t.canonical_reference(F.concat(F.lit("( a ) , b\\_c "), s))), f"WITH {_Q} SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(replace({_PLAIN.format(chr(39) + '( a ) , b' + chr(92) + '_c ' + chr(39) + ' || s')}, '\\', ''), '“”’–—', '\"\"''--'), '\\s+([,.;:!?])', '\\1', 'g'), '([(\\[{{])\\s+', '\\1', 'g'), '\\s+([)\\]}}])', '\\1', 'g'), ' +', ' ', 'g')) AS v FROM q"),
    "st8_plain_text": (_of(lambda s: t.plain_text(F.concat(s, F.lit(" \\# x")))), f"WITH {_Q} SELECT doc_id, {_PLAIN.format('s || ' + chr(39) + ' ' + chr(92) + '# x' + chr(39))} AS v FROM q"),
    "st9_parse_reference": (st9, _ST9),
    "st10_parse_title": (lambda s, d: table(s, d, "part").select("p_partkey", t.parse_title(F.expr("p_name || CASE p_partkey % 3 WHEN 0 THEN '. arXiv preprint. In X' WHEN 1 THEN '? In Y' ELSE '. Some press.' END")).alias("v")), "SELECT p_partkey, trim(p_name, ' .') AS v FROM part"),
    "st11_reference_heading": (st11, "SELECT o_orderkey, o_orderkey % 8 IN (0, 1, 2, 3, 5) AS is_heading FROM orders"),
    "st12_reference_shape": (st12, f"WITH {_REFS} SELECT p_partkey, regexp_matches(s, '^\\s*([A-Z][A-Za-zÀ-ÖØ-öø-ÿ''`’.-]+|[A-Z]\\.|[a-z][A-Za-z.-]*\\.)') AND (regexp_matches(s, '\\b(18|19|20)[0-9]{{2}}[a-z]?\\b') OR regexp_matches(substr(s, 1, 240), 'https?://')) AS starts, regexp_matches(s, '^\\s*([A-Z][A-Za-zÀ-ÖØ-öø-ÿ''`’.-]+|[A-Z]\\.|[a-z][A-Za-z.-]*\\.)') AND regexp_matches(substr(s, 1, 180), ',| and | et al') AS authors, regexp_matches(s, '\\b(18|19|20)[0-9]{{2}}[a-z]?\\b') AND regexp_matches(s, '[.!?)\\]]\\s*$') AS complete FROM r"),
    "st13_surname_year_keys": (st13, f"WITH {_REFS}, y AS (SELECT p_partkey, regexp_extract(s, '\\b((?:18|19|20)[0-9]{{2}}[a-z]?)\\b', 1) AS year, lower(trim(regexp_replace(p_brand, '[^A-Za-z]+', ' ', 'g'))) AS n FROM r JOIN part USING (p_partkey)) SELECT p_partkey, CASE WHEN year = '' THEN '' ELSE split_part(n, ' ', -1) END AS surname, regexp_replace(year, '[a-z]$', '') AS base_year, regexp_matches(year, '[a-z]$') AS suffixed FROM y"),
    "st18_url_mentions": (st18, "SELECT page_id, rtrim(url, '.,;:!?)]}') || ' https://a.b/c http://x.y/z' AS urls FROM pages"),
    "st19_normalize_url": (_of(t.normalize_url, _pages, "page_id"), f"WITH {_NORM_URL} SELECT page_id, v FROM m"),
    "st20_classify_url": (lambda s, d: _pages(s, d).select("page_id", t.classify_url(F.col("s")).alias("r")).select("page_id", "r.kind", "r.key"), f"WITH {_NORM_URL} SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'github' WHEN 2 THEN 'huggingface' WHEN 4 THEN 'huggingface' WHEN 3 THEN 'arxiv_link' ELSE 'url' END AS kind, CASE page_id % 6 WHEN 1 THEN 'org' || page_id || '/repo' WHEN 2 THEN 'datasets/o/d' || page_id WHEN 4 THEN 'models/org/m' || page_id ELSE v END AS key FROM m"),
    "st21_slug": (_of(t.slug), f"WITH {_Q} SELECT doc_id, trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') AS v FROM q"),
    "st22_norm_name": (lambda s, d: table(s, d, "part").select("p_partkey", t.norm_name(F.concat_ws(" ", "p_name", F.lit("Re² (dataset) model"), "p_brand")).alias("v")), "SELECT p_partkey, regexp_replace(lower(p_name || 're2' || p_brand), '[^a-z0-9]+', '', 'g') AS v FROM part"),
    "st25_arxiv_id": (st25, _ST25),
    "st26_section_title": (_of(t.section_title), f"WITH {_Q} SELECT doc_id, lower(trim(regexp_replace(trim(s), '^[0-9A-Za-z.\\-]+\\s+', ''))) AS v FROM q"),
    "st30_front_matter": (lambda s, d: table(s, d, "pages").select("page_id", F.concat_ws("\n", t.front_matter_line("title", F.concat(F.lit('a "'), "url", F.lit('"'))), t.front_matter_line("note", F.when(F.col("page_id") % 2 == 0, F.lit("")))).alias("v")), """SELECT page_id, 'title: "a \\"' || url || '\\""' AS v FROM pages"""),
    "st31_math_delimiters": (_of(lambda s: t.dollar_math(F.concat(F.lit(r"\("), s, F.lit(r"\) and \[x\]")))), f"WITH {_Q} SELECT doc_id, '$' || s || '$ and $$x$$' AS v FROM q"),
    "st33_head_and_tail": (lambda s, d: table(s, d, "documents").select("doc_id", t.head_and_tail(F.col("text"), 400).alias("v")), "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 300) || chr(10) || chr(10) || '[... truncated for length ...]' || chr(10) || chr(10) || right(text, 100) END AS v FROM documents"),
    "st34_author_filter": (st34, "SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN true WHEN 0 THEN NOT regexp_matches(c_name, '[0-9]') ELSE false END AS good FROM customer"),
    "st37_url_kind": (_of(t.url_kind, _pages, "page_id"), f"WITH {_PAGES}, n AS (SELECT page_id, {_SCHEME} AS u FROM p) SELECT page_id, CASE WHEN regexp_matches(lower({_PATH}), '\\.pdf$|/pdf/') THEN 'pdf' WHEN {_HOST} LIKE '%doi.org' THEN 'doi' ELSE 'landing' END AS v FROM n"),
    "rt8_tokens": (lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(t.tokens(F.col("text")), " ").alias("v")), "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS v FROM documents"),
    "rt10_embedding_text": (rt10, "WITH e AS (SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN chr(10) || 'Also known as: ' || p_brand || ', ' || p_type ELSE '' END || chr(10) || p_type AS text FROM part) SELECT p_partkey, text, substr(sha1('model-1' || chr(10) || text), 1, 16) AS embedding_key FROM e"),
    "ha1_hashes": (lambda s, d: table(s, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.length(t.crc_hex(F.col("text"))).alias("crc_digits")), "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, 8 AS crc_digits FROM documents"),
    "ha1_payload_hash": (ha1_payload, _HA1_PAYLOAD),
    "ag21_token_estimate": (lambda s, d: table(s, d, "documents").select("doc_id", t.estimated_tokens(F.col("text")).alias("v")), "SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS v FROM documents"),
    "ma1_box_geometry": (ma1, oracle("blocks", "SELECT doc, idx, round((x1 - x0) * (y1 - y0), 9) AS area, round(greatest(0.0, least(x1, 0.4::DOUBLE) - greatest(x0, 0.1::DOUBLE)) * greatest(0.0, least(y1, 0.4::DOUBLE) - greatest(y0, 0.1::DOUBLE)) / ((x1 - x0) * (y1 - y0)), 9) AS overlap FROM blocks")),
    "ma3_cosine_to_unit": (lambda s, d: table(s, d, "embeddings").select("vec_id", F.round((1 + F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda p, x: p + x * x)) / 2, 5).alias("v")), "SELECT vec_id, round((1 + list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) / 2, 5) AS v FROM embeddings"),
}
