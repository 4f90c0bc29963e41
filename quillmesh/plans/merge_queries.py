"""Queries of asset and entry resolution, source selection, JSON helpers, reference repair and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmesh.functions import html_text as ht
from quillmesh.functions import json_text as js
from quillmesh.operators import merging, records
from quillmesh.operators import reports as p
from quillmesh.plans.report_queries import _rows
from quillmesh.session import shared_folder, table
from quillmesh.sources import adapters as a
from quillmesh.sources import files
from quillmesh.sources.adapters import oracle
from quillmesh.streaming import stages, states


def jn26(spark, sf_dir):
    fields, rejected = p.semantic_update(F.expr("map('key', 'k', 'role', 'old')"), F.expr("map('role', p_type, 'key', 'z', CASE WHEN p_partkey % 2 = 0 THEN 'line' ELSE 'page' END, '1')"), ["role"])
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(fields, "role").alias("role"), F.element_at(fields, "key").alias("key"), F.array_join(rejected, ",").alias("rejected"))


def jn24(spark, sf_dir):
    wanted = _rows("part", "p_partkey AS paper", "concat('fig', p_partkey % 3) AS name")(spark, sf_dir)
    files = _rows("part", "p_partkey AS paper", "explode(CASE p_partkey % 4 WHEN 0 THEN array(concat('img/fig', p_partkey % 3, '.png'), concat('fig', p_partkey % 3, '.pdf')) WHEN 1 THEN array(concat('deep/down/fig', p_partkey % 3, '.svg')) WHEN 2 THEN array(concat('x/fig', p_partkey % 3, '.svg'), concat('y/fig', p_partkey % 3, '.svg')) ELSE array('other.png') END) AS path")(spark, sf_dir)
    return p.resolved_assets(wanted, files, ["", "img/"], [".png", ".pdf"])


_JN24 = "SELECT p_partkey AS paper, 'fig' || (p_partkey % 3) AS name, CASE p_partkey % 4 WHEN 0 THEN 'fig' || (p_partkey % 3) || '.pdf' WHEN 1 THEN 'deep/down/fig' || (p_partkey % 3) || '.svg' END AS path FROM part"


def jn29(spark, sf_dir):
    known = _rows("part", "p_partkey AS id", "concat('s', p_partkey) AS s2", "concat('a', p_partkey) AS arxiv", "CASE WHEN p_partkey % 2 = 0 THEN concat('10.1/', p_partkey) END AS doi", "concat('Title No. ', p_partkey) AS title")(spark, sf_dir)
    asked = _rows("part", "p_partkey AS entry", "CASE p_partkey % 5 WHEN 0 THEN concat('s', p_partkey) WHEN 1 THEN 's-none' END AS s2", "CASE WHEN p_partkey % 5 = 1 THEN concat('a', p_partkey) END AS arxiv", "CASE WHEN p_partkey % 5 = 2 THEN concat('10.1/', p_partkey) END AS doi", "CASE WHEN p_partkey % 5 = 4 THEN 'unknown words' ELSE concat('TITLE no ', p_partkey) END AS title")(spark, sf_dir)
    return p.resolved_entries(asked, known)


_JN29 = "SELECT p_partkey AS entry, CASE WHEN p_partkey % 5 <> 4 THEN p_partkey END AS id, CASE p_partkey % 5 WHEN 0 THEN 's2' WHEN 1 THEN 'arxiv' WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'doi' ELSE 'title' END WHEN 3 THEN 'title' ELSE 'mismatch' END AS by FROM part"
_BOUND = ("l_orderkey AS request", "l_suppkey % 3 AS material", "l_returnflag AS version", "l_linenumber % 4 AS location", "l_linenumber AS priority", "CAST(l_quantity AS BIGINT) AS size", "l_partkey AS target")


def ac9(spark, sf_dir):
    found = p.selected_sources(_rows("lineitem", *_BOUND)(spark, sf_dir), 60)
    return found.withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ","))


_AC9 = f"""WITH b AS (SELECT {', '.join(_BOUND)} FROM lineitem), o AS (SELECT request, material, version, location, min(priority) AS priority, max(size) AS size, list_sort(list(DISTINCT target)) AS t FROM b GROUP BY ALL)
SELECT request, material, version, location, priority, size, array_to_string(list_transform(t, lambda x: CAST(x AS VARCHAR)), ',') AS targets, CASE WHEN sum(size) OVER (PARTITION BY request ORDER BY priority, material, version, location ROWS UNBOUNDED PRECEDING) <= 60 THEN 'selected' ELSE 'over-budget' END AS state FROM o"""


def wn11(spark, sf_dir):
    return p.interleaved(a.blocks(spark, sf_dir).filter("type = 'caption'"), "doc", "idx", "type")


def st39(spark, sf_dir):
    found = p.numbered_block(F.split("text", "\n"), 200, 700)
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.md5(found).alias("md5"))


_NESTED = """concat('{"a": [{"img_caption": ["fig ', event_id, '", 3, {"t": "part"}]}, "plain"], "n": null, "k": ', event_id, ', "Footnote": "f"}')"""


def js1(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(f"CASE WHEN event_id % 9 = 0 THEN '{{broken' ELSE {_NESTED} END").alias("j"))
    return e.select("event_id", F.array_join(js.strings_of(F.col("j")), "|").alias("strings"), F.array_join(js.strings_of(F.col("j"), True), "|").alias("captions"))


_ANSWER = """concat('Here {not json} it is: ', CASE event_id % 3 WHEN 0 THEN '```json ' WHEN 1 THEN '{"x": {"y": 1}} then ' ELSE '' END, '{"paper_id": "p', event_id, '", "references": [1, {"a": "}"}]} and {"paper_id": "late", "references": []}')"""


def js3(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(f"CASE WHEN event_id % 7 = 0 THEN 'no object' ELSE {_ANSWER} END").alias("text"))
    return e.select("event_id", js.json_object_in(F.col("text"), ("paper_id", "references")).alias("found"))


_PARTS = "array(concat(p_brand, ', A. and Bee, C. ', 1950 + p_partkey % 70, '. ', p_type, ' of multi-'), concat('modal things ', p_partkey, '. In Proceedings.'), '', concat('Dee, E. and ', p_name, '. 2001. Short one.'), concat('Dee, E. and ', p_name, '. 2001. Short one.'))"


def wn5(spark, sf_dir):
    named = table(spark, sf_dir, "part").withColumn("p_brand", F.lit("Abc")).withColumn("p_name", F.lit("Fox, G.")).select("p_partkey", p.repaired_references(F.expr(_PARTS)).alias("r"))
    return named.select("p_partkey", F.array_join("r.entries", "|").alias("entries"), F.col("r.joined").cast("long").alias("joined"))


_WN5 = "SELECT p_partkey, 'Abc, A. and Bee, C. ' || (1950 + p_partkey % 70) || '. ' || p_type || ' of multimodal things ' || p_partkey || '. In Proceedings.|Dee, E. and Fox, G.. 2001. Short one.' AS entries, CAST(1 AS BIGINT) AS joined FROM part"


def _streamed(spark, sf_dir, change, keys):
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    states.into_batches(change(log), f"{path}/out", f"{path}/checkpoint")
    return states.last_of_batches(spark.read.parquet(f"{path}/out"), keys)


def stream_latest(spark, sf_dir):
    change = lambda log: states.running_latest(log.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])
    return _streamed(spark, sf_dir, change, ["user_id"]).select("user_id", "event_id", "event_type")


def stream_windows(spark, sf_dir):
    change = lambda log: states.windowed_counts(log.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").select(F.unix_seconds("window.start").alias("start"), "event_type", "n")
    return _streamed(spark, sf_dir, change, ["start", "event_type"])


#: How many appends the log of stages comes in.
APPENDS = 4


def stream_stages(spark, sf_dir):
    """Events as a log of stages that comes in appends, in the order of time, each a batch or more of its own."""
    path = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    log = table(spark, sf_dir, "events").selectExpr("user_id AS paper", "event_type AS stage", "CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status", "cast(ts AS timestamp) AS at", "event_id AS seq")
    first, last = log.agg(F.unix_seconds(F.min("at")), F.unix_seconds(F.max("at")) + 1).first()
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", states.STORE)
    second = F.unix_seconds("at")
    for i in range(APPENDS if first is not None else 0):
        lower, upper = (first + (last - first) * k // APPENDS for k in (i, i + 1))
        log.filter((second >= lower) & (second < upper)).write.mode("append").parquet(f"{path}/log")
        changes = stages.stage_changes(own.readStream.schema(log.schema).parquet(f"{path}/log"), "6 hours", "1 hour")
        states.into_batches(changes, f"{path}/out", f"{path}/checkpoint")
    if first is None:
        return stages.stage_totals(log, "1970-01-01")
    return stages.stage_states(spark.read.parquet(f"{path}/out").drop("batch")).withColumn("at", F.unix_micros("at"))


_STAGES = """WITH s AS (SELECT user_id AS paper, event_type AS stage, max(ts) AS t, arg_max(event_id, (ts, event_id)) AS seq FROM events GROUP BY ALL)
SELECT paper, stage, CASE WHEN seq % 3 = 0 THEN 'failed' ELSE 'done' END AS status, epoch_us(t) AS "at", seq, max(t) OVER (PARTITION BY paper) + INTERVAL 6 HOUR < (SELECT max(t) FROM s) - INTERVAL 1 HOUR AS stale FROM s"""

QUERIES = {
    "sk6_stage_states": (stream_stages, _STAGES),
    "jn26_semantic_update": (jn26, "SELECT p_partkey, p_type AS role, 'k' AS key, CASE WHEN p_partkey % 2 = 0 THEN 'key,line' ELSE 'key,page' END AS rejected FROM part"),
    "jn24_resolved_assets": (jn24, _JN24),
    "jn29_resolved_entries": (jn29, _JN29),
    "ac9_select_sources": (ac9, _AC9),
    "wn11_interleaved_captions": (wn11, oracle("blocks", "SELECT doc, array_to_string(list(type ORDER BY idx), ' ') AS caption FROM blocks WHERE type = 'caption' GROUP BY doc")),
    "st39_prompt_block": (st39, "WITH d AS (SELECT doc_id, string_split(text, chr(10))[1:200] AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string(list_transform(l, lambda x, i: '[' || CAST(i AS VARCHAR) || '] ' || substr(x, 1, 700)), chr(10))) AS md5 FROM d"),
    "js1_json_strings": (js1, "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN 'fig ' || event_id || '|part|plain|f' END AS strings, CASE WHEN event_id % 9 <> 0 THEN 'fig ' || event_id || '|part|f' END AS captions FROM events"),
    "js3_object_in_text": (js3, """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN '{"paper_id":"p' || event_id || '","references":[1,{"a":"}"}]}' END AS found FROM events"""),
    "wn5_repaired_references": (wn5, _WN5),
    "sk4_stream_latest": (stream_latest, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "sk6_stream_windows": (stream_windows, "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
}


def dc2(spark, sf_dir):
    found = ht.html_to_markdown(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", found.alias("markdown")).select("page_id", F.char_length("markdown").cast("long").alias("chars"), F.md5("markdown").alias("md5"))


def dc1(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", ht.html_sections(F.col("html")).alias("p"))
    return found.select("page_id", "p.title", F.size("p.sections").cast("long").alias("n_sections"), F.get("p.sections", 0)["title"].alias("first"))


# no SQL reads tag soup; tests/test_edges.py has golden cases. The titles of the driver's pages have no markup.
QUERIES["dc2_html_to_markdown"] = (dc2, None)
QUERIES["dc1_html_sections"] = (dc1, None)
QUERIES["dc1_page_titles"] = (lambda s, d: dc1(s, d).select("page_id", "title"), "SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')) AS title FROM pages")


_RESULTS = ("l_orderkey AS request", "l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS item", "CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('V', l_suppkey % 2) ELSE concat('v', l_suppkey % 2) END AS version", "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS unit", "l_quantity AS value")


def ac13(spark, sf_dir):
    return records.comparable_pairs(_rows("lineitem", *_RESULTS)(spark, sf_dir), "request", "item", {"version": F.col("version"), "unit": F.col("unit")}, "value")


_AC13 = f"""WITH r AS (SELECT {', '.join(_RESULTS)} FROM lineitem), j AS (SELECT a.request, a.item AS a, b.item AS b, a.value - b.value AS d, CASE WHEN lower(a.version) = lower(b.version) THEN true END AND a.unit = b.unit AS comparable FROM r a JOIN r b ON a.request = b.request AND a.item < b.item)
SELECT request, a, b, comparable, CASE WHEN comparable THEN d END AS difference FROM j"""


def sc8(spark, sf_dir):
    path = f"{shared_folder(spark)}/xml-{uuid.uuid4().hex}"
    paper = F.expr("concat('<paper id=\"', c_custkey, '\"><title>', c_name, ' &amp; more</title>', CASE WHEN c_custkey % 2 = 0 THEN concat('<author>A', c_custkey, '</author><author>B</author>') ELSE '' END, '</paper>')")
    table(spark, sf_dir, "customer").select(paper.alias("value")).write.text(path)
    found = files.read_xml_lines(spark, path, "_id bigint, title string, author array<string>")
    return found.select(F.col("_id").alias("id"), "title", F.array_join(F.coalesce("author", F.array().cast("array<string>")), ",").alias("authors"))


def sc11(spark, sf_dir):
    pages = _rows("customer", "c_custkey div 4 AS paper", "(c_custkey % 4) * 2 AS start", "CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE array(c_name, concat('x', c_custkey)) END AS data")(spark, sf_dir)
    return files.paged(pages, "paper", "start", "data")


QUERIES["ac13_comparable_pairs"] = (ac13, _AC13)
QUERIES["sc8_xml_source"] = (sc8, "SELECT CAST(c_custkey AS BIGINT) AS id, c_name || ' & more' AS title, CASE WHEN c_custkey % 2 = 0 THEN 'A' || c_custkey || ',B' ELSE '' END AS authors FROM customer")
QUERIES["sc11_paged_references"] = (sc11, "SELECT c_custkey // 4 AS paper, CAST((c_custkey % 4) * 2 AS BIGINT) AS place, c_name AS item FROM customer WHERE c_custkey % 4 <> 3 UNION ALL SELECT c_custkey // 4, CAST((c_custkey % 4) * 2 + 1 AS BIGINT), 'x' || c_custkey FROM customer WHERE c_custkey % 4 <> 3")


_MERGE_KEYS = ("CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey // 16 END", "CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END", "CASE WHEN o_orderkey % 5 < 2 THEN concat(o_orderpriority, substr(cast(o_orderdate AS VARCHAR), 1, 10)) END")


def jn10_merged(spark, sf_dir):
    """Orders as records with up to three keys: an id, a link and a name."""
    keys = [F.expr(k.replace("//", "div").replace("VARCHAR", "STRING")) for k in _MERGE_KEYS]
    rows = table(spark, sf_dir, "orders").withColumn("title", F.expr("CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END")).withColumn("tags", F.array("o_orderpriority"))
    found = merging.merged_records(rows, "o_orderkey", ["o_orderkey"], keys, ["title", "o_totalprice"], ["tags"])
    return found.select("o_orderkey", "title", F.col("o_totalprice").alias("price"), F.array_join("tags", ",").alias("tags"), "n_rows")


_JN10_MERGED = f"""WITH RECURSIVE k AS (SELECT o_orderkey AS id, unnest([1, 2, 3]) AS rank, unnest([CAST({_MERGE_KEYS[0]} AS VARCHAR), CAST({_MERGE_KEYS[1]} AS VARCHAR), {_MERGE_KEYS[2]}]) AS key FROM orders),
b AS (SELECT id, rank, lag(id) OVER (PARTITION BY rank, key ORDER BY id) AS prior FROM k WHERE key IS NOT NULL), t AS (SELECT id, arg_min(prior, rank) AS prior FROM b WHERE prior IS NOT NULL GROUP BY id),
r AS (SELECT o_orderkey AS id, o_orderkey AS root FROM orders WHERE o_orderkey NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, r.root FROM r JOIN t ON t.prior = r.id),
m AS (SELECT root, o.*, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS title FROM r JOIN orders o ON o.o_orderkey = r.id),
g AS (SELECT root, arg_min(title, o_orderkey) FILTER (title IS NOT NULL) AS title, arg_min(o_totalprice, o_orderkey) AS price, count(*) AS n_rows FROM m GROUP BY root),
p AS (SELECT root, o_orderpriority AS tag, min(o_orderkey) AS first FROM m GROUP BY ALL)
SELECT g.root AS o_orderkey, title, price, (SELECT string_agg(tag, ',' ORDER BY first) FROM p WHERE p.root = g.root) AS tags, n_rows FROM g"""

QUERIES["jn10_merged_records"] = (jn10_merged, _JN10_MERGED)
