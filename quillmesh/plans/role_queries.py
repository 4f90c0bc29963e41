"""The query of all roles around all nodes, with its SQL: documents are contents, orders experiments, events observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import roles as ro
from quillmesh.session import settled, table

_C, _E, _O, _M = "concat('content_', doc_id)", "concat('experiment_', o_orderkey)", "concat('observation_', event_id)", "concat('model_', p_partkey)"
#: (table, source, type, target) as expressions that Spark and DuckDB both read; there is no edge where the target is null.
_EDGES = (
    ("documents", _C, "FROM", "concat('paper_', doc_id % 97)"),
    ("documents", _C, "ABOUT", "CASE WHEN doc_id % 2 = 0 THEN concat('model_', doc_id % 61) ELSE concat('method_', doc_id % 23) END"),
    ("documents", _C, "RESPONDS_TO", "CASE WHEN doc_id % 5 = 0 THEN concat('method_', doc_id % 29) END"),
    ("documents", _C, "EXPRESSES", "CASE WHEN doc_id % 7 = 0 THEN concat('method_', doc_id % 31) END"),
    ("documents", _C, "SUPPORTED_BY", "CASE WHEN doc_id % 3 = 0 THEN concat('experiment_', doc_id) END"),
    ("orders", _E, "EVALUATES", "concat('model_', o_custkey % 211)"),
    ("orders", _E, "USES", "concat('dataset_', o_orderkey % 13)"),
    ("orders", _E, "MEASURED_BY", "concat('metric_', o_orderkey % 4)"),
    ("orders", _E, "USES_PROTOCOL", "CASE WHEN o_orderkey % 3 = 0 THEN concat('protocol_', o_custkey % 5) END"),
    ("orders", _E, "FROM", "concat('paper_', o_custkey)"),
    ("part", _M, "VERSION_OF", "CASE WHEN p_partkey % 3 > 0 THEN concat('model_', p_partkey - 1) END"),
    ("part", _M, "PART_OF", "CASE WHEN p_partkey % 4 = 0 THEN concat('dataset_', p_partkey % 13) END"),
    ("events", _O, "OBSERVES", "concat('model_', user_id)"),
    ("events", _O, "CHECKS", "CASE WHEN event_id % 2 = 0 THEN concat('content_', event_id % 150) END"),
    ("events", _O, "USES_PROTOCOL", "CASE WHEN event_id % 6 = 0 THEN 'protocol_0' END"),
)
_FAMILY = "CASE WHEN id LIKE 'content%' THEN 'Content' WHEN id LIKE 'method%' THEN 'Concept' ELSE 'Entity' END"
_KIND = "CASE WHEN id LIKE 'experiment%' THEN 'Experiment' WHEN id LIKE 'content%' THEN CASE CAST(substr(id, 9) AS BIGINT) % 3 WHEN 0 THEN 'usage' WHEN 1 THEN 'description' ELSE 'claim' END ELSE 'other' END"


def ac6_roles(spark, sf_dir):
    parts = [table(spark, sf_dir, t).selectExpr(f"{s} AS src", f"'{k}' AS type", f"{d} AS dst") for t, s, k, d in _EDGES]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    edges = edges.filter("dst is not null")
    nodes = settled(edges.selectExpr("explode(array(src, dst)) AS id").distinct().selectExpr("id", f"{_FAMILY} AS family", f"{_KIND} AS kind"))
    found = ro.roles_around(nodes.select("id"), nodes, edges, depth=2)
    return found.groupBy("ref", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("via").alias("n_via"), F.min("other").alias("first_other"), F.max("other").alias("last_other"))


def _sql() -> str:
    edges = " UNION ALL ".join(f"SELECT {s} AS src, '{k}' AS type, {d} AS dst FROM {t} WHERE {d} IS NOT NULL" for t, s, k, d in _EDGES)
    into = lambda kind, more="": f"SELECT dst AS ref, src AS other, NULL::VARCHAR AS via, type AS way FROM edges WHERE type = '{kind}'{more}"
    of_content = lambda kind: f" AND src IN (SELECT id FROM nodes WHERE kind = '{kind}')"
    of_family = lambda family: f" AND dst IN (SELECT id FROM nodes WHERE family = '{family}')"
    contents = "', '".join(ro.CONTENTS)
    is_content = " AND src LIKE 'content%'"
    down = lambda role, kind: f"SELECT dst AS ref, src AS other, NULL AS via, '{role}' AS role, type AS way FROM edges WHERE type = '{kind}' UNION ALL SELECT b.dst, a.src, NULL, '{role}', a.type FROM edges a JOIN edges b ON a.dst = b.src AND a.type = b.type WHERE a.type = '{kind}'"
    onward = lambda role, starts, *kinds: f"SELECT s.ref, e.dst AS other, s.via, '{role}' AS role, e.type AS way FROM {starts} s JOIN edges e ON s.at = e.src AND e.type IN ({', '.join(map(repr, kinds))})"
    itself = "SELECT id AS ref, id AS at, NULL::VARCHAR AS via FROM nodes"
    through = lambda cte, roles: f"SELECT ref, other, other FROM {cte} WHERE role IN ({roles})"
    return f"""WITH edges AS (SELECT DISTINCT * FROM ({edges})), ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), nodes AS (SELECT id, {_FAMILY} AS family, {_KIND} AS kind FROM ids),
c AS (SELECT *, 'source_contents' AS role FROM ({into("FROM", is_content + of_family("Entity"))}) UNION ALL SELECT *, 'usage' FROM ({into("ABOUT", of_content("usage"))}) UNION ALL SELECT *, 'descriptions' FROM ({into("ABOUT", of_content("description"))})
 UNION ALL SELECT *, 'answers' FROM ({into("RESPONDS_TO")}) UNION ALL SELECT *, 'expressions' FROM ({into("EXPRESSES")})),
k AS (SELECT DISTINCT * FROM ({itself} WHERE family = 'Content' UNION ALL {through("c", f"'{contents}'")})),
x AS (SELECT DISTINCT * FROM ({into("EVALUATES")} UNION ALL SELECT k.ref, e.dst, k.at, e.type FROM k JOIN edges e ON k.at = e.src AND e.type = 'SUPPORTED_BY' UNION ALL SELECT id, id, NULL, 'self' FROM nodes WHERE kind = 'Experiment')),
o AS ({into("OBSERVES")}),
ka AS (SELECT * FROM k), ps AS (SELECT DISTINCT * FROM ({itself} UNION ALL SELECT ref, other, other FROM x UNION ALL SELECT ref, other, other FROM o)),
pp AS (SELECT DISTINCT * FROM ({itself} WHERE kind = 'Experiment' UNION ALL SELECT ref, other, other FROM x WHERE other <> ref)), oo AS (SELECT ref, other AS at, other AS via FROM o),
f AS (SELECT id AS ref, id AS other, NULL::VARCHAR AS via, 'definition' AS role, 'self' AS way FROM nodes WHERE family = 'Concept' UNION ALL SELECT ref, other, via, role, way FROM c UNION ALL {onward("discussed_objects", "ka", "ABOUT")} UNION ALL SELECT ref, other, via, 'experiments', way FROM x
 UNION ALL {down("versions", "VERSION_OF")} UNION ALL {down("parts", "PART_OF")} UNION ALL SELECT ref, other, via, 'observations', way FROM o UNION ALL {onward("checked_claims", "oo", "CHECKS")} UNION ALL {onward("protocol", "ps", "USES_PROTOCOL")} UNION ALL {onward("participants", "pp", *ro.TAKING_PART)}),
r AS (SELECT DISTINCT * FROM ({itself} UNION ALL SELECT ref, other, other FROM f WHERE role <> 'definition' AND other <> ref)),
a AS (SELECT DISTINCT ref, role, other, via, way FROM (SELECT ref, role, other, via, way FROM f UNION ALL SELECT ref, role, other, via, way FROM ({onward("sources", "r", "FROM")})))
SELECT ref, role, count(*) AS n, count(DISTINCT via) AS n_via, min(other) AS first_other, max(other) AS last_other FROM a GROUP BY ref, role"""


QUERIES = {"ac6_roles": (ac6_roles, _sql())}
