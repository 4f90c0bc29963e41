"""Queries of reports, rules, merges, Markdown sections and file sources over the driver tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmesh.functions import markdown as md
from quillmesh.functions import text as t
from quillmesh.operators import bibliography as b
from quillmesh.operators import records as r
from quillmesh.operators import reports as p
from quillmesh.operators import retrieval
from quillmesh.plans.retrieval_queries import _CHANNELS, _channels
from quillmesh.session import shared_folder, table
from quillmesh.sources import adapters as a
from quillmesh.sources import files
from quillmesh.sources.adapters import oracle

_LOOSE = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


def _rows(name: str, *columns: str):
    """A function (spark, sf_dir) that gives columns of a table by expressions."""
    return lambda spark, sf_dir: table(spark, sf_dir, name).selectExpr(*columns)


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END"
_log = _rows("orders", "o_custkey AS paper", "o_orderdate AS at", "o_orderkey AS seq", f"{_STATUS} AS status")
_LOG = f"s AS (SELECT o_custkey AS paper, o_orderdate AS at, o_orderkey AS seq, {_STATUS} AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"


def _states(spark, sf_dir):
    return r.latest(_log(spark, sf_dir), "paper", ["at", "seq"])


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper"))


def ag10(spark, sf_dir):
    return p.batch_summary(_tasks(spark, sf_dir), _states(spark, sf_dir).select("paper", "status"), "paper")


def tk5(spark, sf_dir):
    both = _tasks(spark, sf_dir).join(_states(spark, sf_dir), "paper", "left")
    return both.select("paper", p.task_priority(F.col("status")).cast("long").alias("priority")).filter("priority < 99")


def ag14(spark, sf_dir):
    title = F.when(F.char_length("title") > 20, F.col("title"))
    return p.field_coverage(a.mentions(spark, sf_dir), "paper_id", {"year_cov": F.col("year"), "title_cov": title}, {"low": F.col("confidence") == "low", "dated": F.col("raw").rlike("[0-9]")})


def ag15(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.format_string("paper_%d", "doc_id").alias("paper_id"), F.size(F.split("text", "\n")).alias("actual"))
    n = a.mentions(spark, sf_dir).groupBy("paper_id").agg(F.count(F.lit(1)).alias("expected"))
    return d.join(n, "paper_id", "left").select("paper_id", p.beyond_tolerance(F.col("actual"), F.coalesce("expected", F.lit(0))).alias("warned"))


_AG15 = ", n AS (SELECT paper_id, count(*) AS e FROM mentions GROUP BY paper_id), d AS (SELECT 'paper_' || CAST(doc_id AS VARCHAR) AS paper_id, len(string_split(text, chr(10))) AS a FROM documents WHERE text IS NOT NULL) SELECT paper_id, coalesce(e > 0 AND abs(a - e) > greatest(3, floor(greatest(a, e) * 0.15::DOUBLE)), false) AS warned FROM d LEFT JOIN n USING (paper_id)"
_REFS = ("l_orderkey AS paper", "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_suppkey % 10 END AS ref", "l_shipdate AS seen", "l_linenumber AS n")
_CONTEXTS = ("l_suppkey AS paper", "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_partkey END AS ref", "l_orderkey * 10 + l_linenumber AS id")


def ag9(spark, sf_dir):
    found = p.contexts_of_references(_rows("lineitem", *_CONTEXTS)(spark, sf_dir), "paper", "ref", "id")
    return found.withColumn("context_ids", F.array_join(F.col("context_ids").cast("array<string>"), ","))


def ag4(spark, sf_dir):
    found = p.citing_sets(a.mentions(spark, sf_dir), t.loose(F.col("title")), "paper_id")
    return found.withColumn("citing_paper_ids", F.md5(F.array_join("citing_paper_ids", ",")))


def ag19(spark, sf_dir):
    return a.blocks(spark, sf_dir).groupBy("doc", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if("merge_prev").alias("n_merged"))


_KNOWN = ("s_suppkey AS id", "CASE WHEN s_suppkey % 3 = 0 THEN concat('r', s_suppkey) END AS resource_id", "concat('u', s_suppkey % 17) AS url", "concat(s_nationkey, s_name) AS kind_name")
_INCOMING = ("s_suppkey AS q", "concat('r', s_suppkey * 2) AS resource_id", "CASE WHEN s_suppkey % 2 = 0 THEN concat('u', s_suppkey % 17) END AS url", "concat(s_nationkey, s_name) AS kind_name")


def jn10(spark, sf_dir):
    found = p.first_matching_key(_rows("supplier", *_INCOMING)(spark, sf_dir), _rows("supplier", *_KNOWN)(spark, sf_dir), ["resource_id", "url", "kind_name"], "id")
    return found.select("q", "match", "matched_by")


_JN10 = f"""WITH k AS (SELECT {', '.join(_KNOWN)} FROM supplier), i AS (SELECT {', '.join(_INCOMING)} FROM supplier),
m AS (SELECT q, (SELECT min(id) FROM k WHERE k.resource_id = i.resource_id) AS a, (SELECT min(id) FROM k WHERE k.url = i.url) AS b, (SELECT min(id) FROM k WHERE k.kind_name = i.kind_name) AS c FROM i)
SELECT q, coalesce(a, b, c) AS match, CASE WHEN a IS NOT NULL THEN 'resource_id' WHEN b IS NOT NULL THEN 'url' WHEN c IS NOT NULL THEN 'kind_name' END AS matched_by FROM m"""

_OLD = _rows("part", "p_partkey div 20 AS paper", "p_partkey AS seq", "p_type AS name", "p_partkey % 3 AS m")
_NEW = _rows("part", "p_partkey div 20 AS paper", "p_partkey AS seq", "CASE WHEN p_partkey % 4 = 0 THEN concat('new ', p_type) ELSE upper(p_type) END AS name", "p_partkey % 3 AS m")
_NAMES = f"""o AS (SELECT p_partkey // 20 AS paper, {_LOOSE.format('p_type')} AS key, arg_max(p_type, p_partkey) AS old_name FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL),
w AS (SELECT p_partkey // 20 AS paper, p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new ' || p_type ELSE upper(p_type) END AS name FROM part WHERE p_partkey % 3 <> 1),
n AS (SELECT paper, {_LOOSE.format('name')} AS key, arg_max(name, p_partkey) AS new_name FROM w GROUP BY ALL),
c AS (SELECT paper, key, old_name, new_name, CASE WHEN new_name IS NULL THEN 'missing' WHEN old_name IS NULL THEN 'extra' ELSE 'matched' END AS status FROM o FULL JOIN n USING (paper, key))"""


def jn20(spark, sf_dir):
    return p.compared_by_name(_OLD(spark, sf_dir).filter("m <> 0"), _NEW(spark, sf_dir).filter("m <> 1"), "paper", "name", "seq")


def jn21(spark, sf_dir):
    found = jn20(spark, sf_dir)
    return p.rescued(found.filter("status = 'missing'"), found.filter("new_name is not null"), "paper", "key")


_AVAILABLE = "CASE WHEN page_id % 2 = 0 THEN 'available' ELSE 'unknown' END AS availability"


def jn22(spark, sf_dir):
    rows = _rows("pages", "page_id", "url", "regexp_replace(url, '[?].*$', '') AS canonical", _AVAILABLE)(spark, sf_dir)
    found = _rows("pages", "page_id", "regexp_replace(url, '[?].*$', '') AS url", "CASE WHEN page_id % 2 = 0 THEN 'missing' ELSE 'ok' END AS status")(spark, sf_dir)
    return p.with_resolution(rows, found.filter("page_id % 3 = 0").select("url", "status"), "url", "canonical", "availability").select("page_id", "availability", "resolution")


_JN22 = f"""WITH p AS (SELECT page_id, url, regexp_replace(url, '[?].*$', '') AS canonical, {_AVAILABLE} FROM pages), f AS (SELECT canonical AS u, max(CASE WHEN page_id % 2 = 0 THEN 'missing' ELSE 'ok' END) AS status FROM p WHERE page_id % 3 = 0 GROUP BY canonical),
j AS (SELECT page_id, availability, coalesce(x.status, y.status) AS resolution FROM p LEFT JOIN f x ON x.u = url LEFT JOIN f y ON y.u = canonical)
SELECT page_id, CASE WHEN availability = 'available' AND resolution = 'missing' THEN 'missing' ELSE availability END AS availability, resolution FROM j"""


def jn23(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    places = F.array(F.lit(1), F.lit(3), F.lit(2), (F.col("doc_id") % 7 + 1).cast("int"))
    return d.select("doc_id", F.md5(F.array_join(p.titles_at(md.lines(F.col("text")), places), "|")).alias("md5"))


def jn25(spark, sf_dir):
    rows = _rows("part", "p_type AS type", "p_partkey AS name", "md5(p_name) AS hash")(spark, sf_dir)
    actual = _rows("part", "p_type AS type", "p_partkey AS name", "md5(concat(p_name, CASE WHEN p_partkey % 10 = 0 THEN '!' ELSE '' END)) AS hash")(spark, sf_dir).filter("name % 5 = 0")
    return p.with_actual(rows, actual, ["type", "name"], "hash")


def jn28(spark, sf_dir):
    rows = _rows("customer", "c_custkey AS k", "CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS a", "CASE WHEN c_custkey % 4 <> 0 THEN concat('ph', c_custkey % 9) END AS b")(spark, sf_dir)
    other = _rows("customer", "c_custkey AS k", "'filled' AS a", "c_name AS b")(spark, sf_dir).filter("k % 2 = 0")
    return p.filled_from(rows, other, "k", ["a", "b"])


_PAPER = "concat('2025.acl-demo', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('.', p_partkey) END)"


def pf9(spark, sf_dir):
    warned = F.expr("CASE WHEN p_partkey % 7 = 0 THEN array('ok', 'This is NOT a research paper') WHEN p_partkey % 11 = 0 THEN array('Front-Matter page') END")
    return table(spark, sf_dir, "part").select("p_partkey", p.front_matter(F.expr(_PAPER), warned).alias("front"))


def pf10(spark, sf_dir):
    base = F.expr("map('status', 'new', 'year', '1990', 'title', p_name)")
    update = F.expr("map('status', CASE WHEN p_partkey % 2 = 0 THEN 'done' END, 'title', upper(p_name), 'extra', 'x')")
    merged = F.array_sort(F.transform(F.map_entries(p.merged_fields(base, update, ["status", "title"])), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(merged, ";").alias("fields"))


def mp1(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    found = n.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    full = p.merged_fields(F.expr("map('A', 0L, 'N', 0L, 'R', 0L)"), F.col("m"), ["A", "N", "R"])
    return found.select("l_orderkey", *[F.element_at(full, k).alias(f"n_{k.lower()}") for k in "ANR"])


def pf13(spark, sf_dir):
    return p.renumbered(a.mentions(spark, sf_dir).filter("confidence = 'high'"), "paper_id", ["ref_seq"]).select("paper_id", "ref_seq", "n")


def wn4(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), F.coalesce("value", F.lit(0.0)).alias("e"))
    return p.renumbered(e, "user_id", ["s", "e", "event_id"]).select("event_id", F.format_string("user_%d-m%03d", "user_id", "n").alias("mention"))


def pf14(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kept = p.kept_citation(F.col("text"), F.expr("CASE WHEN doc_id % 3 = 0 THEN array(1) ELSE array() END"), F.expr("CASE WHEN doc_id % 2 = 0 THEN array('a') ELSE array() END"))
    return d.filter(kept).select("doc_id")


def pf18(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    merge = part.filter("k % 7 = 0").selectExpr("k", "CASE WHEN k % 14 = 0 THEN 'FAILED' ELSE 'merged' END AS status")
    run = part.filter("k % 4 <> 0").selectExpr("k", "CASE k % 8 WHEN 1 THEN '' WHEN 3 THEN 'Prepared' ELSE 'done' END AS status")
    return p.quality_ok(part, merge, part.filter("k % 5 <> 0").selectExpr("k", "k % 3 <> 0 AS ok"), run, "k")


def _headings(spark, sf_dir):
    h = a.blocks(spark, sf_dir).select("doc", "idx", (F.pmod(F.col("idx") * 7 + F.col("doc"), F.lit(9)) + 1).alias("level"))
    return b.section_bounds(h, "doc", "idx", "level")


def pf15(include: bool):
    return lambda spark, sf_dir: p.filtered_sections(_headings(spark, sf_dir), "doc", "idx", "end_pos", (F.col("idx") + F.col("doc")) % 5 == 0, include).select("doc", "idx")


_HEADINGS = """, h AS (SELECT doc, idx, (idx * 7 + doc) % 9 + 1 AS level FROM blocks), s AS (SELECT h.doc, h.idx, h.level, (h.idx + h.doc) % 5 = 0 AS chosen, min(n.idx) AS stop FROM h LEFT JOIN h n ON n.doc = h.doc AND n.idx > h.idx AND n.level <= h.level GROUP BY ALL)"""
_BELOW = "EXISTS (SELECT 1 FROM s c WHERE c.chosen AND c.doc = s.doc AND c.idx <= s.idx AND coalesce(c.stop, 9e18::DOUBLE) > s.idx)"
_ABOVE = "EXISTS (SELECT 1 FROM s c WHERE c.chosen AND c.doc = s.doc AND c.idx > s.idx AND c.idx < coalesce(s.stop, 9e18::DOUBLE))"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("q"), F.col("event_id").alias("id"), F.col("value").alias("score"), "event_type")


def tk2(spark, sf_dir):
    return retrieval.fuse(_channels(spark, sf_dir)).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.every("truncated").alias("truncated"))


_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'doi' WHEN 2 THEN 'title' WHEN 3 THEN 'url' ELSE 'arxiv' END"


def so6(spark, sf_dir):
    merged = p.appended(F.array("p_brand", "p_type"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN array(p_brand) ELSE array(p_type, p_name, p_name) END"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(merged, "|").alias("merged"))


def ar1(spark, sf_dir):
    w = F.split("p_type", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_contains(w, "TIN").alias("has"),
        F.size(F.array_distinct(F.concat(w, w))).cast("long").alias("n_distinct"),
        F.array_join(F.slice(w, 2, 2), " ").alias("part"),
        F.array_position(w, "TIN").alias("at"),
        F.array_join(F.sort_array(F.array_union(w, F.array(F.lit("X")))), " ").alias("sorted"),
    )


def dt1(spark, sf_dir):
    age = F.unix_seconds(F.lit("2024-03-01 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), (age > 30 * 86400).alias("expired"))


def js2(spark, sf_dir):
    nested = F.concat(F.lit('{"a":{"b":'), "props", F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", files.dotted(nested, "a.b.k").alias("k"), files.dotted(nested, "a.c.k").alias("none"))


_CUSTOMER = "c_custkey bigint, c_name string, c_mktsegment string, note string"


def _jsonl(spark, sf_dir):
    rows = _rows("customer", "cast(c_custkey AS bigint) AS c_custkey", "c_name", "c_mktsegment", "CASE WHEN c_custkey % 2 = 0 THEN 'é \"quoted\" \\\\ text' END AS note")(spark, sf_dir)
    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, _CUSTOMER)


_JSONL = "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'é \"quoted\" \\ text' END AS note FROM customer"


def sc6(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").selectExpr("n_regionkey AS list", "n_nationkey AS line_no", "CASE n_nationkey % 4 WHEN 0 THEN '# only a comment' WHEN 1 THEN concat('  id', n_regionkey, ' # why') ELSE concat('id', n_nationkey % 7) END AS line")
    return files.listed_ids(rows).select("id", "place.list", "place.line_no")


def sc13(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("v"))
    return own.select("l_orderkey", F.size("v").cast("long").alias("n"), files.truncated(F.col("v"), 5).alias("truncated"))


_MD = """concat_ws(chr(10), concat('# Paper ', doc_id), '## Abstract', coalesce(text, ''), CASE WHEN doc_id % 3 <> 0 THEN concat('## 3. References:', chr(10), '[1] A. One', chr(10), '### More', chr(10), '[2] B. Two') END, CASE WHEN doc_id % 2 = 0 THEN concat('## Appendix  A', chr(10), 'last') END)"""
_LINED = f"d AS (SELECT doc_id, {_MD} AS m FROM documents), l AS (SELECT doc_id, m, string_split(m, chr(10)) AS l FROM d), x AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM l), h AS (SELECT doc_id, i, length(regexp_extract(s, '^(#{{1,6}})\\s+(.+?)\\s*$', 1)) AS lev, trim(regexp_replace(regexp_extract(s, '^(#{{1,6}})\\s+(.+?)\\s*$', 2), '\\s+', ' ', 'g')) AS title FROM x)"


def _md(value, name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", value(F.expr(_MD)).alias(name))


def _body(m):
    return t.let(md.lines(m), lambda ls: F.array_join(F.slice(ls, F.lit(1), F.coalesce(F.array_min(F.transform(ls, lambda x, i: F.when(t.is_reference_heading(x), i))), F.size(ls))), "\n"))


def _outline(m):
    return F.array_join(F.transform(md.section_outline(m), lambda h: F.concat_ws(":", h["level"].cast("string"), h["title"], h["line"].cast("string"))), "|")


_IDS = "CASE p_partkey % 4 WHEN 0 THEN concat('2025.acl-long.', p_partkey) WHEN 1 THEN concat('x2025.', p_partkey) WHEN 2 THEN concat('1999', p_partkey) ELSE concat('20.a.', p_partkey) END"

QUERIES = {
    "sk6_stage_state": (_states, f"WITH {_LOG} SELECT * FROM s"),
    "ag10_batch_summary": (ag10, f"WITH {_LOG} SELECT coalesce(status, 'pending') AS status, count(*) AS n FROM customer LEFT JOIN s ON c_custkey = paper GROUP BY ALL"),
    "ag28_pipeline_status": (lambda s, d: _states(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"WITH {_LOG} SELECT status, count(*) AS n FROM s GROUP BY status"),
    "tk5_task_priority": (tk5, f"WITH {_LOG} SELECT c_custkey AS paper, CAST(CASE WHEN status IN ('failed', 'running') THEN 0 ELSE 1 END AS BIGINT) AS priority FROM customer LEFT JOIN s ON c_custkey = paper WHERE status IS DISTINCT FROM 'done'"),
    "ag11_throughput": (lambda s, d: p.throughput(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts"), "WITH e AS (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) AS us, count(DISTINCT user_id) AS n FROM events) SELECT us / 1e6::DOUBLE AS elapsed, n, round(n * 3.6e9::DOUBLE / us, 1) AS per_hour FROM e"),
    "ag14_field_coverage": (ag14, oracle("mentions", "SELECT paper_id, count(*) AS total, count(*) FILTER (year <> '') / count(*) * 100 AS year_cov, count(*) FILTER (length(title) > 20) / count(*) * 100 AS title_cov, count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (regexp_matches(raw, '[0-9]')) AS dated FROM mentions GROUP BY paper_id")),
    "ag15_tolerance": (ag15, oracle("mentions", _AG15)),
    "ag20_reference_totals": (lambda s, d: p.reference_totals(_rows("lineitem", *_REFS)(s, d), "paper", "ref", "seen", "n"), f"WITH r AS (SELECT {', '.join(_REFS)} FROM lineitem) SELECT paper, count(*) AS n_rows, count(DISTINCT ref) AS n_known, count(*) FILTER (ref IS NULL) AS n_null, count(ref) - count(DISTINCT ref) AS n_repeated, min(seen) AS first_at, max(seen) AS last_at, count(*) = max(n) AS count_matches FROM r GROUP BY paper"),
    "ag26_success_report": (lambda s, d: p.success_report(_rows("orders", "o_custkey", "CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS ok")(s, d), "o_custkey", F.col("ok")), "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed, bool_and(o_orderstatus = 'F') AS all_ok FROM orders GROUP BY o_custkey"),
    "ag8_context_totals": (lambda s, d: p.context_totals(_rows("lineitem", *_CONTEXTS)(s, d), "paper", "ref"), f"WITH c AS (SELECT {', '.join(_CONTEXTS)} FROM lineitem) SELECT count(*) AS contexts, count(ref) AS matched, count(*) - count(ref) AS unresolved, count(DISTINCT paper) AS papers FROM c"),
    "ag9_reference_contexts": (ag9, f"WITH c AS (SELECT {', '.join(_CONTEXTS)} FROM lineitem) SELECT paper, ref, count(*) AS citation_count, array_to_string(list(CAST(id AS VARCHAR) ORDER BY id), ',') AS context_ids FROM c WHERE ref IS NOT NULL GROUP BY paper, ref"),
    "ag4_citing_sets": (ag4, oracle("mentions", f", k AS (SELECT *, {_LOOSE.format('title')} AS key FROM mentions) SELECT key, count(*) AS mention_count, count(DISTINCT paper_id) AS citing_paper_count, md5(array_to_string(list(DISTINCT paper_id ORDER BY paper_id), ',')) AS citing_paper_ids FROM k WHERE key <> '' GROUP BY key")),
    "ag19_block_counts": (ag19, oracle("blocks", "SELECT doc, type, count(*) AS n, count(*) FILTER (merge_prev) AS n_merged FROM blocks GROUP BY doc, type")),
    "jn10_first_matching_key": (jn10, _JN10),
    "jn20_compared_by_name": (jn20, f"WITH {_NAMES} SELECT * FROM c"),
    "jn21_rescue": (jn21, f"WITH {_NAMES} SELECT m.paper, m.key, min(x.key) AS partner FROM c m JOIN c x ON m.paper = x.paper AND x.new_name IS NOT NULL AND length(m.key) >= 4 AND length(x.key) >= 4 AND (contains(x.key, m.key) OR contains(m.key, x.key)) WHERE m.status = 'missing' GROUP BY ALL"),
    "jn22_url_resolution": (jn22, _JN22),
    "jn23_context_titles": (jn23, "WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) SELECT doc_id, md5(concat(coalesce(l[1], ''), '|', coalesce(l[3], ''), '|', coalesce(l[2], ''), '|', coalesce(l[doc_id % 7 + 1], ''))) AS md5 FROM d"),
    "jn25_hash_override": (jn25, "SELECT p_type AS type, p_partkey AS name, CASE WHEN p_partkey % 10 = 0 THEN md5(p_name || '!') ELSE md5(p_name) END AS hash, p_partkey % 10 = 0 AS changed FROM part"),
    "jn28_filled_problems": (jn28, "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'filled' END AS a, CASE WHEN c_custkey % 4 <> 0 THEN concat('ph', c_custkey % 9) ELSE c_name END AS b FROM customer"),
    "pf1_kind_filter": (lambda s, d: p.kind_filter(a.nodes(s, d), "kind", "Dataset").select("id", "name"), oracle("nodes", "SELECT id, name FROM nodes WHERE kind = 'Dataset'")),
    "pf9_front_matter": (pf9, "SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0 AS front FROM part"),
    "pf10_merged_fields": (pf10, "SELECT p_partkey, 'status=' || CASE WHEN p_partkey % 2 = 0 THEN 'done' ELSE 'new' END || ';title=' || upper(p_name) || ';year=1990' AS fields FROM part"),
    "mp1_histogram_map": (mp1, "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_n, count(*) FILTER (l_returnflag = 'R') AS n_r FROM lineitem GROUP BY l_orderkey"),
    "pf12_chain_breaks": (lambda s, d: p.chain_breaks(_rows("orders", "o_orderkey div 10 AS chain", "o_orderkey AS start", "1 AS size")(s, d), "chain", "start", "size").select("chain", "start", "next"), "SELECT o_orderkey // 10 AS chain, o_orderkey AS start, lead(o_orderkey) OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS next FROM orders QUALIFY next <> start + 1"),
    "pf13_renumbered": (pf13, oracle("mentions", "SELECT paper_id, ref_seq, row_number() OVER (PARTITION BY paper_id ORDER BY ref_seq) AS n FROM mentions WHERE confidence = 'high'")),
    "wn4_mention_numbers": (wn4, "SELECT event_id, 'user_' || CAST(user_id AS VARCHAR) || '-m' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS mention FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, coalesce(value, 0), event_id) AS n FROM events)"),
    "pf14_kept_citations": (pf14, "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0 AND length(text) <= 500"),
    "pf18_quality_ok": (pf18, "SELECT p_partkey AS k, p_partkey % 14 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 8 NOT IN (1, 3) AS ok, p_partkey % 5 <> 0 AND NOT (p_partkey % 14 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 8 NOT IN (1, 3)) AS failed FROM part"),
    "pf15_sections_excluded": (pf15(False), oracle("blocks", f"{_HEADINGS} SELECT doc, idx FROM s WHERE NOT {_BELOW}")),
    "pf15_sections_included": (pf15(True), oracle("blocks", f"{_HEADINGS} SELECT doc, idx FROM s WHERE {_BELOW} OR {_ABOVE}")),
    "wn7_heading_tree": (lambda s, d: _headings(s, d).select("doc", "idx", "parent_pos"), oracle("blocks", f"{_HEADINGS} SELECT s.doc, s.idx, max(n.idx) AS parent_pos FROM s LEFT JOIN s n ON n.doc = s.doc AND n.idx < s.idx AND n.level < s.level GROUP BY ALL")),
    "tk1_channel_pool": (lambda s, d: retrieval.top(_scored(s, d), retrieval.POOL).select("q", "id", "score"), "SELECT user_id AS q, event_id AS id, value AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) <= 20"),
    "tk2_fused_top": (tk2, f"WITH {_CHANNELS}, f AS (SELECT q, id FROM ranked GROUP BY q, id) SELECT q, least(count(*), 5) AS n, count(*) > 5 AS truncated FROM f GROUP BY q"),
    "tk3_overfetch": (lambda s, d: p.overfetched(_scored(s, d), F.col("event_type") == "error", 3).select("q", "id"), "WITH w AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) <= 15) SELECT user_id AS q, event_id AS id FROM w WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) <= 3"),
    "tk6_key_rank": (lambda s, d: table(s, d, "part").select("p_partkey", p.key_rank(F.expr(_KIND)).alias("rank")), "SELECT p_partkey, CAST([5, 2, 1, 4, 3][p_partkey % 5 + 1] AS BIGINT) AS rank FROM part"),
    "tk7_capped_contexts": (lambda s, d: p.capped_contexts(a.mentions(s, d), "paper_id", ["ref_seq"], "raw", 3, 40).select("paper_id", "n", "raw"), oracle("mentions", "SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY ref_seq) AS n, substr(raw, 1, 40) AS raw FROM mentions QUALIFY n <= 3")),
    "so6_appended": (so6, "SELECT p_partkey, p_brand || '|' || p_type || CASE WHEN p_partkey % 3 = 0 OR p_name IN (p_brand, p_type) THEN '' ELSE '|' || p_name END AS merged FROM part"),
    "ar1_list_operations": (ar1, "WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part) SELECT p_partkey, list_contains(w, 'TIN') AS has, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, array_to_string(w[2:3], ' ') AS part, CAST(coalesce(list_position(w, 'TIN'), 0) AS BIGINT) AS at, array_to_string(list_sort(list_distinct(list_append(w, 'X'))), ' ') AS sorted FROM w"),
    "dt1_age": (dt1, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, epoch(TIMESTAMP '2024-03-01') - floor(epoch(ts)) > 30 * 86400 AS expired FROM events"),
    "js2_dotted_path": (js2, "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS \"none\" FROM events"),
    "sk3_jsonl_sink": (_jsonl, _JSONL),
    "sc2_jsonl_source": (lambda s, d: _jsonl(s, d).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("n_notes")), "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS n_notes FROM customer GROUP BY ALL"),
    "sc3_find_record": (lambda s, d: files.find_record(_jsonl(s, d), "c_custkey", 7), f"SELECT * FROM ({_JSONL}) WHERE c_custkey = 7"),
    "sc6_listed_ids": (sc6, "WITH l AS (SELECT n_regionkey AS list, n_nationkey AS line_no, CASE n_nationkey % 4 WHEN 1 THEN 'id' || CAST(n_regionkey AS VARCHAR) ELSE 'id' || CAST(n_nationkey % 7 AS VARCHAR) END AS id FROM nation WHERE n_nationkey % 4 <> 0) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY list, line_no) = 1"),
    "sc13_truncated_lists": (sc13, "SELECT l_orderkey, count(*) AS n, count(*) >= 5 AS truncated FROM lineitem GROUP BY l_orderkey"),
    "st4_folded_title": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(md.folded_title(F.col("text"))).alias("md5")), "SELECT doc_id, md5(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]', '', 'g')) AS md5 FROM documents"),
    "st16_strip_references": (_md(lambda m: F.md5(md.strip_references(m)), "md5"), f"""WITH {_LINED.replace('{{', '{').replace('}}', '}')}, r AS (SELECT doc_id, min(i) AS i, arg_min(lev, i) AS lev FROM h WHERE lev > 0 AND regexp_replace(rtrim(lower(title), '.:'), '^[0-9ivx.\\s]+', '') IN ('references', 'bibliography', 'reference') GROUP BY doc_id),
e AS (SELECT r.doc_id, min(h.i) AS e FROM r JOIN h ON h.doc_id = r.doc_id AND h.i > r.i AND h.lev BETWEEN 1 AND r.lev GROUP BY ALL)
SELECT doc_id, md5(CASE WHEN r.i IS NULL THEN m WHEN e IS NULL THEN array_to_string(l[1:r.i - 1], chr(10)) ELSE array_to_string(l[1:r.i - 1] || l[e:], chr(10)) END) AS md5 FROM l LEFT JOIN r USING (doc_id) LEFT JOIN e USING (doc_id)"""),
    "st17_body": (_md(lambda m: F.md5(_body(m)), "md5"), f"""WITH {_LINED.replace('{{', '{').replace('}}', '}')}, r AS (SELECT doc_id, min(i) AS i FROM x WHERE regexp_matches(rtrim(trim(s), '.:'), '(?i)^\\s*(?:#+\\s*)?(?:\\d+(?:\\.\\d+)*\\.?\\s*)?(?:references?|bibliography|works\\s+cited)\\s*$') GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN r.i IS NULL THEN m ELSE array_to_string(l[1:r.i - 1], chr(10)) END) AS md5 FROM l LEFT JOIN r USING (doc_id)"""),
    "st23_outline": (_md(_outline, "outline"), f"""WITH {_LINED.replace('{{', '{').replace('}}', '}')}, g AS (SELECT doc_id, i, lev, title, min(CASE WHEN lower(title) IN ('references', 'bibliography', 'reference') THEN i END) OVER (PARTITION BY doc_id) AS stop FROM h WHERE lev > 0)
SELECT doc_id, array_to_string(list(CAST(lev AS VARCHAR) || ':' || title || ':' || CAST(i AS VARCHAR) ORDER BY i), '|') AS outline FROM g WHERE stop IS NULL OR i < stop GROUP BY doc_id"""),
    "st23_first_heading": (_md(md.first_heading, "title"), "SELECT doc_id, 'Paper ' || CAST(doc_id AS VARCHAR) AS title FROM documents"),
    "st24_year_and_venue": (lambda s, d: table(s, d, "part").select("p_partkey", md.year_of(F.expr(_IDS)).alias("year"), md.venue_of(F.expr(_IDS)).alias("venue")), "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2025' WHEN 2 THEN '1999' ELSE 'unknown' END AS year, CASE p_partkey % 4 WHEN 0 THEN 'ACL-LONG 2025' ELSE '' END AS venue FROM part"),
}
