"""Queries of the write path: a batch made from the parts whose outcome is known for each remainder of the key, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import commit as c
from quillmesh.session import settled, table

#: By p_partkey % 10: 0 known, 1 and 9 new, 2 changed, 3 alias of another, 4 known with a new alias, 5 identifier of another,
#: 6 object of other labels, 7 shared URL, 8 unclear key. The store holds the even ones.
_BATCH = (
    "concat('b', p_partkey) AS ref",
    "array('Entity', 'Model') AS labels",
    "concat(CASE WHEN p_partkey % 2 = 0 THEN 'm' ELSE 'n' END, p_partkey) AS name",
    "CASE WHEN p_partkey % 10 = 2 THEN 'changed' ELSE 'd' END AS text",
    "CAST(NULL AS STRING) AS direction",
    "CASE p_partkey % 10 WHEN 5 THEN array(concat('s2:', p_partkey - 1)) WHEN 7 THEN array(concat('url:', p_partkey div 20)) WHEN 9 THEN array(concat('doi:', p_partkey)) ELSE CAST(array() AS ARRAY<STRING>) END AS identifiers",
    "CASE p_partkey % 10 WHEN 3 THEN array(concat('m', p_partkey - 1)) WHEN 4 THEN array(concat('x', p_partkey)) ELSE CAST(array() AS ARRAY<STRING>) END AS aliases",
    "false AS own_id",
    "true AS plain",
    "p_partkey",
)


def _batch(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*_BATCH)


def _store(spark, sf_dir):
    even = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0")
    id_ = "concat('model_', p_partkey) AS id"
    nodes = even.selectExpr(id_, "CASE WHEN p_partkey % 10 = 6 THEN array('Entity', 'Dataset') ELSE array('Entity', 'Model') END AS labels", "concat('m', p_partkey) AS name", "'d' AS text", "array(concat('s2:', p_partkey)) AS identifiers")
    keys = even.selectExpr("concat('m', p_partkey, '|Model|global') AS key", "concat('m', p_partkey) AS raw", "CASE WHEN p_partkey % 10 = 8 THEN 'ambiguous' ELSE 'active' END AS status", id_)
    edges = even.filter("p_partkey % 20 = 0").selectExpr("concat('model_', p_partkey) AS src", "'PART_OF' AS type", "concat('model_', p_partkey + 2) AS dst")
    return nodes, keys, edges


def _rels(spark, sf_dir, most):
    return table(spark, sf_dir, "part").filter(f"p_partkey % 10 = 0 AND p_partkey + 2 <= {most}").selectExpr("concat('b', p_partkey) AS a", "'PART_OF' AS type", "concat('b', p_partkey + 2) AS c")


def _most(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]


def ac3(spark, sf_dir):
    return c.commit_plan(_batch(spark, sf_dir), _rels(spark, sf_dir, _most(spark, sf_dir)), *_store(spark, sf_dir))


_KEYS_SQL = """SELECT 'b' || k AS ref, CASE WHEN k % 10 = 8 THEN 'conflict:key-ambiguous' WHEN k % 2 = 0 THEN 'key:same' ELSE 'key:new' END AS action, CASE WHEN k % 2 = 0 THEN 'm' ELSE 'n' END || k || '|Model|global' AS what FROM p
UNION ALL SELECT 'b' || k, 'conflict:key-taken', 'm' || (k - 1) || '|Model|global' FROM p WHERE k % 10 = 3
UNION ALL SELECT 'b' || k, 'key:new', 'x' || k || '|Model|global' FROM p WHERE k % 10 = 4"""
_AC3 = f"""WITH p AS (SELECT p_partkey AS k, max(p_partkey) OVER () AS most, count(*) OVER (PARTITION BY p_partkey // 20, p_partkey % 10) AS near FROM part)
SELECT 'b' || k AS ref, CASE WHEN k % 2 = 1 THEN 'node:new' WHEN k % 10 = 6 THEN 'conflict:label-mismatch' WHEN k % 10 = 2 THEN 'node:update' ELSE 'node:same' END AS action, CASE WHEN k % 2 = 1 THEN 'n' || k ELSE 'model_' || k END AS what FROM p
UNION ALL {_KEYS_SQL}
UNION ALL SELECT 'b' || k, 'conflict:identifier-taken', 's2:' || (k - 1) FROM p WHERE k % 10 = 5
UNION ALL SELECT 'b' || k, 'candidate', 'url:' || (k // 20) FROM p WHERE k % 10 = 7 AND near > 1
UNION ALL SELECT 'b' || k, CASE WHEN k % 20 = 0 THEN 'rel:same' ELSE 'rel:new' END, 'PART_OF b' || (k + 2) FROM p WHERE k % 10 = 0 AND k + 2 <= most"""


def ac16(spark, sf_dir):
    batch, (_, keys, _) = _batch(spark, sf_dir), _store(spark, sf_dir)
    return c.key_actions(batch, keys, c.targets(batch, keys))


def _next(spark, sf_dir):
    clean = _batch(spark, sf_dir).filter("p_partkey % 10 IN (0, 1, 2, 4, 9)")
    most = _most(spark, sf_dir)
    store = _store(spark, sf_dir)
    last = spark.createDataFrame([("Model", most)], "kind string, last_number long")
    rels = _rels(spark, sf_dir, most)
    after = tuple(settled(df) for df in c.applied(clean, rels, *store, last))
    return clean, rels, after


def sk1(spark, sf_dir):
    nodes, _, _ = _next(spark, sf_dir)[2]
    return nodes.select("id", "name", "text", F.size("identifiers").cast("long").alias("n_identifiers"))


_SK1 = """WITH p AS (SELECT p_partkey AS k, max(p_partkey) OVER () AS most FROM part), f AS (SELECT k, most + row_number() OVER (ORDER BY 'b' || k) AS n FROM p WHERE k % 10 IN (1, 9))
SELECT 'model_' || k AS id, 'm' || k AS name, CASE WHEN k % 10 = 2 THEN 'changed' ELSE 'd' END AS text, CAST(1 AS BIGINT) AS n_identifiers FROM p WHERE k % 2 = 0
UNION ALL SELECT 'model_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END, 'n' || k, 'd', CAST(CASE WHEN k % 10 = 9 THEN 1 ELSE 0 END AS BIGINT) FROM f"""


def replanned(spark, sf_dir):
    """What a second plan of an applied batch would still do: nothing but find all of it."""
    clean, rels, after = _next(spark, sf_dir)
    return c.commit_plan(clean, rels, *after).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_REPLAN = """WITH p AS (SELECT p_partkey AS k, max(p_partkey) OVER () AS most FROM part) SELECT 'node:same' AS action, count(*) AS n FROM p WHERE k % 10 IN (0, 1, 2, 4, 9)
UNION ALL SELECT 'key:same', count(*) + count(*) FILTER (k % 10 = 4) FROM p WHERE k % 10 IN (0, 1, 2, 4, 9) UNION ALL SELECT 'rel:same', count(*) FROM p WHERE k % 10 = 0 AND k + 2 <= most"""

_FAULTY = (
    "CASE WHEN p_partkey % 31 = 0 THEN concat('b', p_partkey - 1) ELSE concat('b', p_partkey) END AS ref",
    "CASE p_partkey % 13 WHEN 1 THEN array('Entity') WHEN 2 THEN array('Entity', 'Task') WHEN 3 THEN array('Concept', 'Metric') ELSE array('Entity', 'Model') END AS labels",
    "CASE p_partkey % 17 WHEN 1 THEN '' WHEN 2 THEN concat('a|', p_partkey) ELSE concat('n', p_partkey) END AS name",
    "CASE WHEN p_partkey % 19 = 1 THEN NULL ELSE 'd' END AS text",
    "CASE WHEN p_partkey % 2 = 0 THEN 'lower' END AS direction",
    "CASE p_partkey % 23 WHEN 1 THEN array('isbn:1') WHEN 2 THEN array('doi:') WHEN 3 THEN array('s2:same') ELSE array(concat('url:', 'same')) END AS identifiers",
    "CASE WHEN p_partkey % 29 = 1 THEN array('Shared  Name') ELSE CAST(array() AS ARRAY<STRING>) END AS aliases",
    "p_partkey % 37 = 1 AS own_id",
    "p_partkey % 41 <> 1 AS plain",
)


def pf2(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rels = part.filter("p_partkey % 7 = 0").selectExpr("concat('b', p_partkey) AS a", "CASE p_partkey % 3 WHEN 0 THEN 'PART_OF' WHEN 1 THEN 'FOR_TASK' ELSE 'LIKES' END AS type", "CASE WHEN p_partkey % 5 = 0 THEN 'nowhere' ELSE 'b1' END AS c")
    rels = rels.unionByName(rels.filter("a = 'b21'"))
    return c.seed_violations(part.selectExpr(*_FAULTY), rels)


_PF2 = """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 31 = 0 THEN 'b' || (p_partkey - 1) ELSE 'b' || p_partkey END AS ref FROM part),
n AS (SELECT *, CASE k % 13 WHEN 1 THEN NULL WHEN 2 THEN 'Task' WHEN 3 THEN 'Metric' ELSE 'Model' END AS kind, CASE k % 13 WHEN 3 THEN 'Concept' ELSE 'Entity' END AS family FROM p),
r AS (SELECT k, 'b' || k AS a, CASE k % 3 WHEN 0 THEN 'PART_OF' WHEN 1 THEN 'FOR_TASK' ELSE 'LIKES' END AS type, CASE WHEN k % 5 = 0 THEN 'nowhere' ELSE 'b1' END AS c FROM p WHERE k % 7 = 0),
e AS (SELECT r.*, EXISTS (SELECT 1 FROM n WHERE ref = a) AND c = 'b1' AS inside, (SELECT min(family) FROM n WHERE ref = a) AS fam FROM r),
s AS (SELECT DISTINCT ref, kind FROM n WHERE k % 29 = 1)
SELECT DISTINCT * FROM (SELECT ref, 'two-labels' AS rule FROM n WHERE k % 13 = 1 UNION ALL SELECT ref, 'kind-not-allowed' FROM n WHERE k % 13 IN (1, 2)
UNION ALL SELECT ref, 'own-id' FROM n WHERE k % 37 = 1 UNION ALL SELECT ref, 'text-missing' FROM n WHERE k % 17 = 1 OR k % 19 = 1 UNION ALL SELECT ref, 'direction' FROM n WHERE kind = 'Metric' AND k % 2 = 1
UNION ALL SELECT ref, 'not-plain' FROM n WHERE k % 41 = 1 UNION ALL SELECT ref, 'unknown-namespace' FROM n WHERE k % 23 IN (1, 2) UNION ALL SELECT ref, 'bar-in-name' FROM n WHERE k % 17 = 2
UNION ALL SELECT ref, 'duplicate-ref' FROM n GROUP BY ref HAVING count(*) > 1 UNION ALL SELECT ref, 'shared-identifier' FROM n WHERE k % 23 = 3 AND (SELECT count(DISTINCT ref) FROM n WHERE k % 23 = 3) > 1
UNION ALL SELECT ref, 'shared-key' FROM s WHERE (SELECT count(DISTINCT ref) FROM s t WHERE t.kind IS NOT DISTINCT FROM s.kind) > 1
UNION ALL SELECT ref, 'shared-key' FROM n WHERE k % 17 = 1 AND (SELECT count(DISTINCT ref) FROM n t WHERE t.k % 17 = 1 AND t.kind IS NOT DISTINCT FROM n.kind) > 1
UNION ALL SELECT a, 'end-missing' FROM e WHERE NOT inside UNION ALL SELECT a, 'unknown-type' FROM e WHERE type = 'LIKES'
UNION ALL SELECT a, 'ends-not-allowed' FROM e WHERE inside AND type <> 'LIKES' AND NOT (type = 'PART_OF' AND fam = 'Entity')
UNION ALL SELECT 'b21', 'duplicate-relation')"""

QUERIES = {
    "ac3_commit_plan": (ac3, _AC3),
    "ac3_plan_again": (replanned, _REPLAN),
    "ac16_register_names": (ac16, f"WITH p AS (SELECT p_partkey AS k FROM part) {_KEYS_SQL}"),
    "sk1_apply_plan": (sk1, _SK1),
    "pf2_seed_rules": (pf2, _PF2),
}
