"""Queries of the graph operators over the adapted tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import graph as g
from quillmesh.session import table
from quillmesh.sources import adapters as a
from quillmesh.sources.adapters import oracle


def _joined(c: str):
    return F.array_join(F.array_sort(c), ",").alias(c)


def _mentions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return parts.select(F.col("p_partkey").alias("q"), F.col("p_name").alias("mention")).union(parts.select(F.col("p_partkey") + 1_000_000, F.upper("p_name")))


_MENTIONS = """, q AS (SELECT p_partkey AS q, p_name AS mention FROM part UNION ALL SELECT p_partkey + 1000000, upper(p_name) FROM part)"""


def jn1(spark, sf_dir):
    found = g.exact_owners(_mentions(spark, sf_dir), a.name_keys(spark, sf_dir), "Method")
    return found.select("q", "mention", _joined("owners"), "status")


def jn2(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select(F.concat(F.lit("url:"), "p_brand").alias("identifier")).distinct()
    return g.holders(wanted, a.nodes(spark, sf_dir))


def jn3(spark, sf_dir):
    batch = a.nodes(spark, sf_dir).select("id", "family", F.when(F.col("kind") == "Model", "Code").otherwise(F.col("kind")).alias("kind"))
    return g.label_mismatches(batch, a.nodes(spark, sf_dir)).select("id", "kind", "stored_kind")


def jn4(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    batch = s.select(F.concat(F.lit("dataset_s"), "s_suppkey").alias("src"), F.lit("PART_OF").alias("type"), F.concat(F.lit("dataset_n"), F.col("s_suppkey") % 25).alias("dst"))
    return g.existing_edges(batch, a.edges(spark, sf_dir))


def _refs(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0")
    return p.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 40 == 0, F.format_string("model_%04d", "p_partkey")).otherwise(F.concat(F.lit("model_x"), "p_partkey")).alias("id"))


_PAD = "CASE WHEN p_partkey < 10000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END"
_REFS = f", refs AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 40 = 0 THEN 'model_' || {_PAD} ELSE 'model_x' || CAST(p_partkey AS VARCHAR) END AS id FROM part WHERE p_partkey % 20 = 0)"


def ac2(spark, sf_dir):
    return g.get(_refs(spark, sf_dir), a.nodes(spark, sf_dir), a.name_keys(spark, sf_dir)).select("pos", "id", "found", "family", "kind", "name", _joined("aliases"))


def so4(spark, sf_dir):
    return g.missing(_refs(spark, sf_dir), a.nodes(spark, sf_dir))


def jn6(spark, sf_dir):
    ids = a.nodes(spark, sf_dir).filter("kind = 'Dataset'").select("id")
    return g.neighbours(ids, a.edges(spark, sf_dir), a.nodes(spark, sf_dir))


def jn7(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.concat(F.lit("experiment_"), "o_orderkey").alias("id"))
    return g.statements(ids, a.edges(spark, sf_dir)).select("id", _joined("papers"), "n_neighbours")


def jn8(spark, sf_dir):
    return g.papers_by_shared_method(a.edges(spark, sf_dir).filter("role is null or version is null or version = '1996'"), "method_0003")


def jn8_counts(spark, sf_dir):
    return g.shared_counts(g.shared_members(a.edges(spark, sf_dir)))


def jn8_pairs(spark, sf_dir):
    """The pairs of all methods and years, counted by paper."""
    return g.shared_by_paper(g.shared_members(a.edges(spark, sf_dir)))


_MEMBERS = """, members AS (SELECT e.dst AS method, e.version, f.dst AS paper, max(CASE WHEN e.role = 'target' THEN 1 ELSE 0 END) AS t, max(CASE WHEN e.role = 'baseline' THEN 1 ELSE 0 END) AS b FROM edges e JOIN edges f ON e.src = f.src AND f.type = 'FROM' WHERE e.type = 'EVALUATES' GROUP BY ALL),
pairs AS MATERIALIZED (SELECT x.method, x.version, x.paper, y.paper AS other FROM members x JOIN members y ON x.method = y.method AND x.version = y.version AND x.t = 1 AND y.b = 1 AND x.paper < y.paper)"""


def jn9(spark, sf_dir):
    return g.methods_with_models(a.edges(spark, sf_dir), a.nodes(spark, sf_dir))


def _roots(spark, sf_dir):
    return a.nodes(spark, sf_dir).filter("description = 'region'").select("id")


_DOWN = """, step AS (SELECT dst AS d, src AS nxt FROM edges WHERE type IN ('PART_OF', 'VERSION_OF')), seeds AS (SELECT id FROM nodes WHERE description = 'region'),
l1 AS (SELECT s.id AS root, nxt AS id FROM seeds s JOIN step ON s.id = d), l2 AS (SELECT root, nxt AS id FROM l1 JOIN step ON id = d),
down AS (SELECT root, id, min(depth) AS depth FROM (SELECT id AS root, id, 0 AS depth FROM seeds UNION ALL SELECT root, id, 1 FROM l1 UNION ALL SELECT root, id, 2 FROM l2) GROUP BY ALL)"""


def ac12(spark, sf_dir):
    return g.expand_down(_roots(spark, sf_dir), a.edges(spark, sf_dir))


def _experiments(spark, sf_dir):
    """All methods on the datasets of each nation, and on each supplier's own."""
    e, nodes = a.edges(spark, sf_dir), a.nodes(spark, sf_dir)
    data = g.expand_down(nodes.filter("description in ('nation', 'supplier')").select("id"), e)
    return g.experiments(a.methods(spark, sf_dir).select(F.col("method_id").alias("id")), e, data)


_EXP = """, step AS (SELECT dst AS d, src AS nxt FROM edges WHERE type IN ('PART_OF', 'VERSION_OF')), seeds AS (SELECT id FROM nodes WHERE description IN ('nation', 'supplier')),
l1 AS (SELECT id AS root, nxt AS id FROM seeds JOIN step ON id = d), l2 AS (SELECT root, nxt AS id FROM l1 JOIN step ON id = d),
data AS (SELECT root, id, min(depth) AS depth FROM (SELECT id AS root, id, 0 AS depth FROM seeds UNION ALL SELECT root, id, 1 FROM l1 UNION ALL SELECT root, id, 2 FROM l2) GROUP BY root, id),
both_ AS (SELECT DISTINCT root, e.src AS experiment, e.dst AS subject, u.dst AS dataset, u.role, depth FROM edges e JOIN edges u ON e.src = u.src AND u.type = 'USES' JOIN data ON u.dst = data.id WHERE e.type = 'EVALUATES'),
found AS (SELECT DISTINCT root, CASE WHEN role IS NULL THEN 'role_missing' WHEN depth = 0 THEN 'matched' ELSE 'expandable' END AS bucket, experiment, subject, dataset FROM both_ WHERE role IS NULL OR role = 'evaluation_data')"""


def ac6(spark, sf_dir):
    return g.context(a.nodes(spark, sf_dir).select("id"), a.edges(spark, sf_dir)).groupBy("ref", "role").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first_other"))


def _context_sql():
    pats = [("usage", "EVALUATES", "dst", "src", ""), ("parts", "PART_OF", "dst", "src", ""), ("whole", "PART_OF", "src", "dst", ""), ("implementations", "IMPLEMENTS", "dst", "src", ""), ("experiments", "FROM", "dst", "src", ""), ("training", "USES", "dst", "src", " AND e.role = 'training_data'"), ("evaluation", "USES", "dst", "src", " AND e.role = 'evaluation_data'")]
    union = " UNION ALL ".join(f"SELECT DISTINCT r.id AS ref, '{n}' AS role, e.{o} AS other FROM refs r JOIN edges e ON r.id = e.{at} AND e.type = '{t}'{x}" for n, t, at, o, x in pats)
    return f", refs AS (SELECT id FROM nodes) SELECT ref, role, count(*) AS n, min(other) AS first_other FROM ({union}) GROUP BY ALL"


def ac7(spark, sf_dir):
    refs = a.nodes(spark, sf_dir).filter("kind = 'Dataset' or kind = 'Method'").select("id")
    return g.evidence(refs, a.edges(spark, sf_dir), ("PART_OF", "IMPLEMENTS"))


def ac8(spark, sf_dir):
    m = a.methods(spark, sf_dir).select(F.col("method_id").alias("id"))
    return g.implementations(m, a.edges(spark, sf_dir), a.nodes(spark, sf_dir))


def wn3(spark, sf_dir):
    n = a.nodes(spark, sf_dir)
    batch = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "signup", "Paper").otherwise("Model").alias("kind"), F.col("event_id").alias("pos"))
    return g.allocate(batch, g.last_numbers(n), F.lower("kind"))


def ac17(spark, sf_dir):
    merged = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - 1).alias("into"))
    return g.follow_merges(merged)


def ac18(spark, sf_dir):
    return g.page_of(a.nodes(spark, sf_dir).select("id", "kind"), F.lit("model_0050"), "id", 40)


def so1(spark, sf_dir):
    e = a.edges(spark, sf_dir)
    return e.filter("type = 'USES' and role = 'training_data'").select(F.col("dst").alias("id")).union(e.filter("type = 'PART_OF'").select(F.col("src").alias("id"))).distinct()


def so3(spark, sf_dir):
    e = a.edges(spark, sf_dir)
    ids = lambda role: e.filter(F.col("role") == role).groupBy("src").agg(F.collect_set("dst").alias(role))
    both = ids("training_data").join(ids("evaluation_data"), "src", "full")
    none = F.array().cast("array<string>")
    cut = F.array_intersect(F.coalesce("training_data", none), F.coalesce("evaluation_data", none))
    return both.select("src", F.array_join(F.array_sort(cut), ",").alias("both"), F.when(F.size(cut) == 0, "none").when(F.size(cut) == 1, "one").otherwise("many").alias("outcome"))


def so5(spark, sf_dir):
    n = lambda what: a.edges(spark, sf_dir).filter(F.col("type") == what).select("src", "dst", F.lit(what).alias("channel"))
    return n("USES").unionByName(n("EVALUATES")).groupBy("src").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("channel").alias("n_channels"))


QUERIES = {
    "jn1_exact_key_lookup": (jn1, oracle("keys", _MENTIONS + ", o AS (SELECT key, array_to_string(list_sort(list(DISTINCT object_id)), ',') AS owners, max(status) AS status FROM name_keys GROUP BY key) SELECT q, mention, coalesce(owners, '') AS owners, status FROM q LEFT JOIN o ON o.key = mention || '|Method|global'")),
    "jn2_identifier_holders": (jn2, oracle("nodes", ", held AS (SELECT id, unnest(identifiers) AS identifier FROM nodes) SELECT DISTINCT identifier, id FROM held WHERE identifier IN (SELECT 'url:' || p_brand FROM part)")),
    "jn3_label_check": (jn3, oracle("nodes", "SELECT id, 'Code' AS kind, kind AS stored_kind FROM nodes WHERE kind = 'Model'")),
    "jn4_edge_exists": (jn4, oracle("edges", "SELECT DISTINCT src AS a, type, dst AS b FROM edges WHERE type = 'PART_OF' AND (src, dst) IN (SELECT 'dataset_s' || CAST(s_suppkey AS VARCHAR), 'dataset_n' || CAST(s_suppkey % 25 AS VARCHAR) FROM supplier)")),
    "ac2_get": (ac2, oracle("keys", _REFS + " SELECT pos, r.id, n.name IS NOT NULL AS found, family, n.kind, n.name, coalesce((SELECT array_to_string(list_sort(list(DISTINCT raw)), ',') FROM name_keys k WHERE k.object_id = r.id AND k.raw <> n.name), '') AS aliases FROM refs r LEFT JOIN nodes n ON r.id = n.id")),
    "jn5_get_in_order": (lambda s, d: ac2(s, d).select("pos", "id", "found"), oracle("nodes", _REFS + " SELECT pos, id, id IN (SELECT id FROM nodes) AS found FROM refs")),
    "so4_missing_refs": (so4, oracle("nodes", _REFS + " SELECT pos, id FROM refs WHERE id NOT IN (SELECT id FROM nodes)")),
    "jn6_entity_info": (jn6, oracle("graph", ", b AS (SELECT src AS id, dst AS t, type || ' → ' AS arrow FROM edges UNION ALL SELECT dst, src, type || ' ← ' FROM edges) SELECT DISTINCT b.id, arrow || n.name AS other FROM b JOIN nodes n ON b.t = n.id WHERE b.id IN (SELECT id FROM nodes WHERE kind = 'Dataset')")),
    "jn7_statement_info": (jn7, oracle("edges", "SELECT 'experiment_' || CAST(o_orderkey AS VARCHAR) AS id, coalesce(array_to_string(list_sort(list(DISTINCT dst) FILTER (type = 'FROM')), ','), '') AS papers, count(DISTINCT dst) FILTER (type <> 'FROM') AS n_neighbours FROM orders LEFT JOIN edges ON src = 'experiment_' || CAST(o_orderkey AS VARCHAR) GROUP BY o_orderkey")),
    "jn8_path_pattern": (jn8, oracle("edges", ", e AS (SELECT * FROM edges WHERE type = 'EVALUATES' AND dst = 'method_0003' AND version = '1996'), p AS (SELECT DISTINCT e.role, e.version, f.dst AS paper FROM e JOIN edges f ON e.src = f.src AND f.type = 'FROM') SELECT DISTINCT x.paper AS paper, y.paper AS other FROM p x JOIN p y ON x.version = y.version AND x.role = 'target' AND y.role = 'baseline' AND x.paper < y.paper")),
    "jn9_methods_with_models": (jn9, oracle("graph", "SELECT n.name AS method, (SELECT count(*) FROM edges WHERE type = 'IMPLEMENTS' AND dst = n.id) AS n_models, (SELECT count(DISTINCT src) FROM edges WHERE type = 'EVALUATES' AND dst = n.id) AS n_experiments FROM nodes n WHERE n.kind = 'Method'")),
    "ac12_narrower_expansion": (ac12, oracle("graph", _DOWN + " SELECT root, id, CAST(depth AS INTEGER) AS depth FROM down")),
    "jn8_shared_counts": (jn8_counts, oracle("edges", _MEMBERS + ", n AS (SELECT method, version, count(*) AS n FROM pairs GROUP BY ALL) SELECT method, version, sum(t)::BIGINT AS n_targets, sum(b)::BIGINT AS n_baselines, coalesce(any_value(n), 0) AS n_pairs FROM members LEFT JOIN n USING (method, version) GROUP BY method, version")),
    "jn8_shared_pairs": (jn8_pairs, oracle("edges", _MEMBERS + " SELECT method, version, paper, count(*) AS n_others, max(other) AS last_other FROM pairs GROUP BY ALL")),
    "ac4_experiments": (_experiments, oracle("graph", _EXP + " SELECT root, bucket, experiment, subject, dataset FROM found")),
    "jn27_experiment_buckets": (lambda s, d: _experiments(s, d).groupBy("root", "bucket", "subject").agg(F.count(F.lit(1)).alias("n")), oracle("graph", _EXP + " SELECT root, bucket, subject, count(*) AS n FROM found GROUP BY ALL")),
    "ag23_experiment_counts": (lambda s, d: g.bucket_counts(_experiments(s, d)), oracle("graph", _EXP + " SELECT bucket, count(DISTINCT experiment) AS n_experiments, count(*) AS n_rows FROM found GROUP BY bucket")),
    "so2_tagged_union": (lambda s, d: _experiments(s, d).groupBy("bucket").agg(F.countDistinct("dataset").alias("n_datasets")), oracle("graph", _EXP + " SELECT bucket, count(DISTINCT dataset) AS n_datasets FROM found GROUP BY bucket")),
    "ac6_context": (ac6, oracle("graph", _context_sql())),
    "ac7_evidence": (ac7, oracle("graph", ", r AS (SELECT id FROM nodes WHERE kind IN ('Dataset', 'Method')), e AS (SELECT DISTINCT src, type, dst FROM edges WHERE type IN ('PART_OF', 'IMPLEMENTS')) SELECT src AS ref, type, 'out' AS direction, dst AS other FROM e WHERE src IN (FROM r) UNION ALL SELECT dst, type, 'in', src FROM e WHERE dst IN (FROM r)")),
    "ac8_implementations": (ac8, oracle("graph", "SELECT dst AS method, src AS resource, n.kind, n.name, CAST(len(identifiers) AS BIGINT) AS n_identifiers FROM edges JOIN nodes n ON src = n.id JOIN methods m ON dst = method_id WHERE type = 'IMPLEMENTS'")),
    "ag16_library_status": (lambda s, d: g.library_status(a.nodes(s, d), a.edges(s, d)), oracle("graph", "SELECT 'node' AS what, concat_ws(':', family, kind) AS label, count(*) AS n FROM nodes GROUP BY ROLLUP (family, kind) UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")),
    "ag17_shared_identifiers": (lambda s, d: g.shared_identifiers(a.nodes(s, d)), oracle("nodes", "SELECT identifier, count(DISTINCT id) AS n_members, min(id) AS first_member, max(id) AS last_member FROM (SELECT id, unnest(identifiers) AS identifier FROM nodes) GROUP BY identifier HAVING count(DISTINCT id) > 1")),
    "ag18_integrity": (lambda s, d: g.integrity(a.nodes(s, d), a.name_keys(s, d), a.edges(s, d, repeated=True)), oracle("graph", "SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT object_id FROM name_keys)) AS nodes_without_key, (SELECT count(*) FROM name_keys WHERE object_id NOT IN (SELECT id FROM nodes)) AS keys_without_node, (SELECT count(*) FROM (SELECT src AS x FROM edges UNION SELECT dst FROM edges) WHERE x NOT LIKE 'experiment_%' AND x NOT IN (SELECT id FROM nodes)) AS dangling_ends")),
    "ag24_last_number": (lambda s, d: g.last_numbers(a.nodes(s, d)), oracle("nodes", "SELECT kind, max(CAST(regexp_extract(id, '_[a-z]?([0-9]+)$', 1) AS BIGINT)) AS last_number FROM nodes GROUP BY kind")),
    "wn3_id_allocation": (wn3, oracle("nodes", ", l AS (SELECT kind, max(CAST(regexp_extract(id, '_[a-z]?([0-9]+)$', 1) AS BIGINT)) AS m FROM nodes GROUP BY kind), b AS (SELECT CASE WHEN event_type = 'signup' THEN 'Paper' ELSE 'Model' END AS kind, event_id AS pos FROM events) SELECT b.kind, pos, format('{}_{:04d}', lower(b.kind), m + row_number() OVER (PARTITION BY b.kind ORDER BY pos)) AS new_id FROM b JOIN l ON b.kind = l.kind")),
    "ac17_merge_chains": (ac17, "SELECT c_custkey AS id, c_custkey - c_custkey % 7 AS survivor FROM customer WHERE c_custkey % 7 <> 0"),
    "ac18_paging": (ac18, oracle("nodes", ", r AS (SELECT id, kind, row_number() OVER (ORDER BY id) AS n FROM nodes WHERE id > 'model_0050') SELECT id, kind, (SELECT count(*) FROM r) > 40 AS more FROM r WHERE n <= 40")),
    "so1_union_distinct": (so1, oracle("edges", "SELECT dst AS id FROM edges WHERE type = 'USES' AND role = 'training_data' UNION SELECT src FROM edges WHERE type = 'PART_OF'")),
    "so3_intersection": (so3, oracle("edges", ", t AS (SELECT src, list(DISTINCT dst) AS x FROM edges WHERE role = 'training_data' GROUP BY src), e AS (SELECT src, list(DISTINCT dst) AS y FROM edges WHERE role = 'evaluation_data' GROUP BY src), b AS (SELECT coalesce(t.src, e.src) AS src, list_sort(list_intersect(coalesce(x, []), coalesce(y, []))) AS c FROM t FULL JOIN e ON t.src = e.src) SELECT src, array_to_string(c, ',') AS both, CASE len(c) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS outcome FROM b")),
    "so5_merge_keeping_provenance": (so5, oracle("edges", "SELECT src, count(*) AS n_rows, count(DISTINCT type) AS n_channels FROM edges WHERE type IN ('USES', 'EVALUATES') GROUP BY src")),
}
