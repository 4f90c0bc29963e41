"""Queries of look-ups, candidate channels, record lint and owners of captions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import candidates as c
from quillmesh.plans.report_queries import _rows
from quillmesh.plans.retrieval_queries import _bm25_sql, _name_sql
from quillmesh.session import table
from quillmesh.sources import adapters as a
from quillmesh.sources.adapters import oracle

_ASK = "CASE p_partkey % 3 WHEN 0 THEN concat(' ', upper(p_name), ' ') WHEN 1 THEN concat('S2:', CAST(p_partkey AS {})) ELSE concat(substr(p_type, 1, 5), ' ', p_name) END"
_SQL_ASK = f"asks AS (SELECT p_partkey AS q, {_ASK.format('VARCHAR')} AS text FROM part WHERE p_partkey % 20 = 0)"


def _asks(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").selectExpr("p_partkey AS q", f"{_ASK.format('STRING')} AS text")


def _nodes(spark, sf_dir):
    return a.nodes(spark, sf_dir).withColumnRenamed("identifiers", "aliases")


_EXACT = """forms AS (SELECT id, lower(trim(name)) AS form, 0 AS nth, 'name' AS hit FROM nodes UNION ALL SELECT id, lower(trim(x)), i, 'alias: ' || x FROM (SELECT id, unnest(identifiers) AS x, generate_subscripts(identifiers, 1) AS i FROM nodes)),
exact AS (SELECT q, id, arg_min(hit, nth) AS hit FROM {0} JOIN forms ON form = lower(trim(text)) GROUP BY q, id)"""
_LOOKUP = f""", {_SQL_ASK}, {_EXACT.format('asks')}, rest AS (SELECT * FROM asks WHERE q NOT IN (SELECT q FROM exact)), words AS (SELECT id, array_to_string(list_prepend(name, identifiers), ' ') AS text FROM nodes),
{_bm25_sql('rest', 'words', 'full_')}, found AS (SELECT q, id, 'exact' AS match, hit FROM exact UNION ALL SELECT q, id, 'fulltext', NULL FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM full_) WHERE place <= 5)"""
_LINKS = ("s_name AS title", "'MAKES' AS type", "CASE WHEN s_suppkey % 2 = 0 THEN 'even' END AS role", "concat('dataset_n', s_nationkey) AS dst")


def _context(spark, sf_dir):
    n = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS q", "lower(n_name) AS text")
    return c.lookup_context(c.lookup(n, _nodes(spark, sf_dir).filter("kind = 'Dataset'")), _rows("supplier", *_LINKS)(spark, sf_dir))


_CONTEXT = """SELECT CAST(n_nationkey AS BIGINT) AS q, 'dataset_n' || n_nationkey AS id, substr(s_name, 1, 24) || ' MAKES' || CASE WHEN s_suppkey % 2 = 0 THEN ' (even)' ELSE '' END AS paper FROM nation JOIN supplier ON s_nationkey = n_nationkey"""

_ENTITY = ("p_partkey AS q", "CASE WHEN p_partkey % 7 <> 0 THEN concat(p_brand, ' ', p_type) END AS mention", "CASE WHEN p_partkey % 3 = 0 THEN concat('method ', p_name) END AS description", "CASE WHEN p_partkey % 4 = 0 THEN 'Model' END AS kind")


def _entities(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").selectExpr(*_ENTITY)


_CHANNELS = f""", e AS (SELECT {', '.join(_ENTITY)} FROM part WHERE p_partkey % 20 = 0), m AS (SELECT q, mention AS text FROM e WHERE mention IS NOT NULL), t AS (SELECT q, description AS text FROM e WHERE description IS NOT NULL),
{_EXACT.format('m')}, name_keys AS (SELECT id AS object_id, unnest(list_prepend(name, identifiers)) AS raw FROM nodes), descr AS (SELECT id, description AS text FROM nodes), {_name_sql('m', 'byname')}, {_bm25_sql('t', 'descr', 'bytext')},
raw_ AS (SELECT q, 'identifier' AS channel, id, CASE WHEN hit = 'name' THEN 2.0 ELSE 1.0 END AS score FROM exact UNION ALL SELECT q, 'lexical_name', id, score FROM byname UNION ALL SELECT q, 'lexical_text', id, score FROM bytext),
ch AS (SELECT q, channel, id, row_number() OVER (PARTITION BY q, channel ORDER BY score DESC, id) AS rank FROM raw_ JOIN e USING (q) JOIN (SELECT id, kind AS k FROM nodes) USING (id) WHERE kind IS NULL OR kind = k QUALIFY rank <= 20)"""


def rt4(spark, sf_dir):
    q = _entities(spark, sf_dir)
    return c.channel_status(q, c.recall_channels(q, _nodes(spark, sf_dir)))


_RT4 = _CHANNELS + """, w AS (SELECT q, unnest(['identifier', 'lexical_name', 'lexical_text']) AS channel, mention IS NOT NULL AS m_on, description IS NOT NULL AS d_on FROM e)
SELECT w.q, w.channel, CASE WHEN CASE WHEN w.channel = 'lexical_text' THEN d_on ELSE m_on END THEN 'ok(' || count(rank) || ')' ELSE 'disabled' END AS status FROM w LEFT JOIN ch ON ch.q = w.q AND ch.channel = w.channel GROUP BY w.q, w.channel, m_on, d_on"""


def rt6(spark, sf_dir):
    found = c.find_entities(c.recall_channels(_entities(spark, sf_dir), _nodes(spark, sf_dir)))
    return found.withColumn("place", F.col("place").cast("long"))


_RT6 = _CHANNELS + """, f AS (SELECT q, id, round(sum(1.0::DOUBLE / (10 + rank)), 9) AS rrf FROM ch WHERE channel <> 'identifier' GROUP BY q, id), p AS (SELECT q, id, rank AS pin FROM ch WHERE channel = 'identifier')
SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY pin NULLS LAST, rrf DESC NULLS LAST, id) AS place, pin IS NOT NULL AS pinned FROM f FULL JOIN p USING (q, id) QUALIFY place <= 5"""

_CLAIM = "CASE (o_orderkey + i) % 4 WHEN 0 THEN 'result' WHEN 1 THEN 'method' WHEN 2 THEN 'guess' END"
_FIGURE = "CASE (o_custkey + i) % 3 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'open' END"
_RUN = "CASE (o_custkey + i) % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'stated' ELSE 'hidden' END"


def pf8(spark, sf_dir):
    items = lambda n, fields: f"transform(slice(array(0, 1, 2, 3), 1, CAST({n} AS INT)), i -> named_struct({fields}))"
    records = _rows(
        "orders",
        "o_orderkey",
        items("o_orderkey % 4", f"'claim_type', {_CLAIM}, 'evidence', CASE WHEN (o_custkey + i) % 6 = 0 THEN 'e' END") + " AS claims",
        items("o_orderkey % 3", "'local_claim_id', CASE WHEN (o_orderkey + i) % 5 = 0 THEN 'c' END") + " AS cites",
        items("o_custkey % 3", f"'figure_id', concat('f', i), 'label', CASE WHEN (o_orderkey + i) % 7 <> 0 THEN 'l' END, 'caption', o_orderpriority, 'status', {_FIGURE}") + " AS figures",
        items("o_custkey % 2", f"'status', {_RUN}") + " AS experiments",
    )(spark, sf_dir)
    return c.lint_records(records, "o_orderkey", ["result", "method"], ["reviewed"], ["none", "stated"])


def _lint_sql(kind: str, n: str, leaf: str, rule: str, problem: str) -> str:
    return f"SELECT o_orderkey, '{kind}[' || i || '].{leaf}' AS path, '{problem}' AS problem FROM (SELECT *, unnest(range({n})) AS i FROM orders) WHERE {rule}"


_PF8 = " UNION ALL ".join([
    "SELECT o_orderkey, 'claims' AS path, 'too-many' AS problem FROM orders WHERE o_orderkey % 4 = 3",
    _lint_sql("claims", "o_orderkey % 4", "evidence", "(o_custkey + i) % 6 = 0", "not-allowed"),
    _lint_sql("claims", "o_orderkey % 4", "claim_type", "(o_orderkey + i) % 4 >= 2", "unknown"),
    _lint_sql("cites", "o_orderkey % 3", "local_claim_id", "(o_orderkey + i) % 5 = 0", "not-allowed"),
    _lint_sql("figures", "o_custkey % 3", "label", "(o_orderkey + i) % 7 = 0", "missing"),
    _lint_sql("figures", "o_custkey % 3", "caption", "o_orderpriority IS NULL", "missing"),
    _lint_sql("figures", "o_custkey % 3", "status", "(o_custkey + i) % 3 <> 0", "unknown"),
    _lint_sql("experiments", "o_custkey % 2", "status", "(o_custkey + i) % 5 >= 2", "unknown"),
])

_TYPE = "CASE WHEN type = 'image' AND idx % 2 = 0 THEN 'table' WHEN type = 'text' AND idx % 3 = 0 THEN 'footnote' WHEN type = 'text' AND idx % 3 = 1 THEN 'table' ELSE type END"


def jn19(spark, sf_dir):
    return c.visual_parents(a.blocks(spark, sf_dir).withColumn("type", F.expr(_TYPE)))


_JN19 = f""", b AS (SELECT * REPLACE ({_TYPE} AS type) FROM blocks),
pairs AS (SELECT c.doc, c.idx, c.type AS kind, m.idx AS main, m.type AS body, abs(c.idx - m.idx) - (SELECT count(*) FROM b x WHERE x.doc = c.doc AND x.idx > least(c.idx, m.idx) AND x.idx < greatest(c.idx, m.idx) AND x.type = c.type) AS far,
 sqrt(greatest(c.x0 - m.x1, m.x0 - c.x1, 0.0::DOUBLE) * greatest(c.x0 - m.x1, m.x0 - c.x1, 0.0::DOUBLE) + greatest(c.y0 - m.y1, m.y0 - c.y1, 0.0::DOUBLE) * greatest(c.y0 - m.y1, m.y0 - c.y1, 0.0::DOUBLE)) AS gap,
 sqrt(((c.x0 + c.x1) / 2 - (m.x0 + m.x1) / 2) * ((c.x0 + c.x1) / 2 - (m.x0 + m.x1) / 2) + ((c.y0 + c.y1) / 2 - (m.y0 + m.y1) / 2) * ((c.y0 + c.y1) / 2 - (m.y0 + m.y1) / 2)) AS centre
 FROM b c JOIN b m ON c.doc = m.doc AND c.type IN ('caption', 'footnote') AND m.type IN ('image', 'chart', 'table') AND (c.type = 'caption' OR m.idx < c.idx)
 WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.doc = c.doc AND x.idx > least(c.idx, m.idx) AND x.idx < greatest(c.idx, m.idx) AND NOT (x.type = 'caption' OR c.type = 'footnote' AND x.type = 'footnote'))),
near AS (SELECT *, max(gap) OVER w - min(gap) OVER w > 0.003 AS differ, bool_and(body = 'table') OVER w AS tables FROM (SELECT * FROM pairs QUALIFY far = min(far) OVER (PARTITION BY doc, idx)) WINDOW w AS (PARTITION BY doc, idx)),
best AS (SELECT doc, idx, main FROM near QUALIFY row_number() OVER (PARTITION BY doc, idx ORDER BY CASE WHEN differ THEN gap END, CASE WHEN NOT differ AND kind = 'caption' AND tables THEN -main WHEN NOT differ AND kind = 'footnote' THEN main END, CASE WHEN NOT differ THEN centre END, main) = 1)
SELECT b.doc, b.idx, main AS parent FROM b LEFT JOIN best USING (doc, idx) WHERE type IN ('caption', 'footnote')"""

QUERIES = {
    "rt11_lookup": (lambda s, d: c.lookup(_asks(s, d), _nodes(s, d)), oracle("nodes", _LOOKUP + " SELECT * FROM found")),
    "rt11_lookup_context": (_context, _CONTEXT),
    "rt4_channel_status": (rt4, oracle("nodes", _RT4)),
    "rt6_find_entities": (rt6, oracle("nodes", _RT6)),
    "pf8_record_lint": (pf8, _PF8),
    "jn19_visual_parents": (jn19, oracle("blocks", _JN19)),
}
