"""The driver tables as a paper graph: nodes, name keys, edges, result units, mentions and blocks.

Each adapter has a twin in DuckDB SQL, in `CTES`, that its oracles start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.session import table


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method_id, name): distinct part names, numbered in order.

    Names are numbered among those of their first three letters, after the names of all groups before; groups are as few as
    there are beginnings, whatever the names.
    """
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("head", F.substring("name", 1, 3))
    ahead = Window.partitionBy(F.lit(0)).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    before = names.groupBy("head").agg(F.count(F.lit(1)).alias("n")).select("head", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("head").orderBy("name")) + F.col("before")
    return names.join(before, "head").select(F.format_string("method_%04d", at).alias("method_id"), "name")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, family, kind, name, identifiers, description): methods, models, datasets and papers."""
    none = F.array().cast("array<string>")

    def part(df: DataFrame, id_, family: str, kind: str, name, identifiers, description) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(family).alias("family"), F.lit(kind).alias("kind"), name.alias("name"), identifiers.alias("identifiers"), description.alias("description"))

    t = {n: table(spark, sf_dir, n) for n in ("part", "supplier", "nation", "region", "customer")}
    c = F.col
    return (
        part(methods(spark, sf_dir), c("method_id"), "Concept", "Method", c("name"), none, F.concat(F.lit("method "), "name"))
        .unionByName(part(t["part"], F.format_string("model_%04d", "p_partkey"), "Entity", "Model", F.concat_ws(" ", "p_brand", "p_type"), F.array(F.concat(F.lit("url:"), "p_brand"), F.concat(F.lit("s2:"), "p_partkey")), c("p_type")))
        .unionByName(part(t["supplier"], F.concat(F.lit("dataset_s"), "s_suppkey"), "Entity", "Dataset", c("s_name"), F.array(F.concat(F.lit("doi:s"), "s_suppkey")), F.lit("supplier")))
        .unionByName(part(t["nation"], F.concat(F.lit("dataset_n"), "n_nationkey"), "Entity", "Dataset", c("n_name"), none, F.lit("nation")))
        .unionByName(part(t["region"], F.concat(F.lit("dataset_r"), "r_regionkey"), "Entity", "Dataset", c("r_name"), none, F.lit("region")))
        .unionByName(part(t["customer"], F.concat(F.lit("paper_"), "c_custkey"), "Entity", "Paper", c("c_name"), none, c("c_mktsegment")))
    )


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, raw, kind, scope, status, object_id): every node under its name; a key of several owners is ambiguous."""
    owned = nodes(spark, sf_dir).select(F.concat_ws("|", "name", "kind", F.lit("global")).alias("key"), F.col("name").alias("raw"), "kind", F.lit("global").alias("scope"), F.col("id").alias("object_id")).distinct()
    shared = owned.groupBy("key").agg(F.when(F.count(F.lit(1)) > 1, "ambiguous").otherwise("active").alias("status"))
    return owned.join(shared, "key").select("key", "raw", "kind", "scope", "status", "object_id")


def edges(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """(src, type, dst, role, version): PART_OF, IMPLEMENTS, FROM, EVALUATES and USES; `repeated` leaves equal edges in, for callers that gather them anyway."""
    none = F.lit(None).cast("string")

    def part(df: DataFrame, src, kind: str, dst, role=none, version=none) -> DataFrame:
        return df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"), role.alias("role"), version.alias("version"))

    t = {n: table(spark, sf_dir, n) for n in ("part", "supplier", "nation", "customer", "orders", "lineitem")}
    named = t["part"].join(methods(spark, sf_dir), F.col("p_name") == F.col("name"))  # broadcast by Spark while it is small
    items = t["lineitem"].join(named.select("p_partkey", "method_id"), F.col("l_partkey") == F.col("p_partkey"))
    of = lambda prefix, key: F.concat(F.lit(prefix), key)
    once = lambda df: df if repeated else df.repartition("src").distinct()  # noqa: E731  # joins and groups by experiment then stay where they are
    exp, year = of("experiment_", "l_orderkey"), F.year("l_shipdate").cast("string")
    return (
        part(t["supplier"], of("dataset_s", "s_suppkey"), "PART_OF", of("dataset_n", "s_nationkey"))
        .unionByName(part(t["nation"], of("dataset_n", "n_nationkey"), "PART_OF", of("dataset_r", "n_regionkey")))
        .unionByName(part(named, F.format_string("model_%04d", "p_partkey"), "IMPLEMENTS", F.col("method_id")))
        .unionByName(part(t["orders"], of("experiment_", "o_orderkey"), "FROM", of("paper_", "o_custkey")))
        .unionByName(once(part(items, exp, "EVALUATES", F.col("method_id"), F.when(F.col("l_linestatus") == "O", "target").otherwise("baseline"), year)))
        .unionByName(once(part(items, exp, "USES", of("dataset_s", "l_suppkey"), F.when(F.col("l_returnflag") == "R", "evaluation_data").when(F.col("l_returnflag") == "A", "training_data"), year)))
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, ref_seq, raw, title, year, confidence): the lines of documents with three words or more, as references."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return lines.filter(F.col("raw").rlike("[A-Za-z]+ [A-Za-z]+ [A-Za-z]+")).select(
        F.format_string("paper_%d", "doc_id").alias("paper_id"),
        F.col("pos").cast("long").alias("ref_seq"),
        "raw",
        F.array_join(F.slice(F.split("raw", " "), 1, 4), " ").alias("title"),
        (F.lit(1990) + F.col("doc_id") % 30).cast("string").alias("year"),
        F.when(F.length("raw") > 60, "high").otherwise("low").alias("confidence"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, idx, type, x0, y0, x1, y1, merge_prev): lines of an order as page blocks, numbered by a total order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    x0, y0 = (F.col("l_quantity") % 10) / 20, (F.col("l_partkey") % 20) / 40.0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"),
        F.row_number().over(order).cast("long").alias("idx"),
        F.when(F.col("l_returnflag") == "R", "image").when(F.col("l_returnflag") == "A", "caption").otherwise("text").alias("type"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 0.1 + F.col("l_discount") * 3).alias("x1"),
        (y0 + 0.1 + F.col("l_tax") * 3).alias("y1"),
        (F.col("l_linestatus") == "O").alias("merge_prev"),
    )


_METHODS = "methods AS (SELECT 'method_' || lpad(CAST(row_number() OVER (ORDER BY name) AS VARCHAR), 4, '0') AS method_id, name FROM (SELECT DISTINCT p_name AS name FROM part))"
_PAD = "CASE WHEN p_partkey < 10000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END"
_NODES = f"""nodes AS (
 SELECT method_id AS id, 'Concept' AS family, 'Method' AS kind, name, CAST([] AS VARCHAR[]) AS identifiers, 'method ' || name AS description FROM methods
 UNION ALL SELECT 'model_' || {_PAD}, 'Entity', 'Model', p_brand || ' ' || p_type, ['url:' || p_brand, 's2:' || CAST(p_partkey AS VARCHAR)], p_type FROM part
 UNION ALL SELECT 'dataset_s' || CAST(s_suppkey AS VARCHAR), 'Entity', 'Dataset', s_name, ['doi:s' || CAST(s_suppkey AS VARCHAR)], 'supplier' FROM supplier
 UNION ALL SELECT 'dataset_n' || CAST(n_nationkey AS VARCHAR), 'Entity', 'Dataset', n_name, CAST([] AS VARCHAR[]), 'nation' FROM nation
 UNION ALL SELECT 'dataset_r' || CAST(r_regionkey AS VARCHAR), 'Entity', 'Dataset', r_name, CAST([] AS VARCHAR[]), 'region' FROM region
 UNION ALL SELECT 'paper_' || CAST(c_custkey AS VARCHAR), 'Entity', 'Paper', c_name, CAST([] AS VARCHAR[]), c_mktsegment FROM customer)"""
_KEYS = """owned AS (SELECT DISTINCT name || '|' || kind || '|global' AS key, name AS raw, kind, 'global' AS scope, id AS object_id FROM nodes),
name_keys AS (SELECT key, raw, kind, scope, CASE WHEN count(*) OVER (PARTITION BY key) > 1 THEN 'ambiguous' ELSE 'active' END AS status, object_id FROM owned)"""
_EDGES = f"""items AS (SELECT l.*, m.method_id FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN methods m ON p_name = m.name),
edges AS (
 SELECT 'dataset_s' || CAST(s_suppkey AS VARCHAR) AS src, 'PART_OF' AS type, 'dataset_n' || CAST(s_nationkey AS VARCHAR) AS dst, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS version FROM supplier
 UNION ALL SELECT 'dataset_n' || CAST(n_nationkey AS VARCHAR), 'PART_OF', 'dataset_r' || CAST(n_regionkey AS VARCHAR), NULL, NULL FROM nation
 UNION ALL SELECT 'model_' || {_PAD}, 'IMPLEMENTS', method_id, NULL, NULL FROM part JOIN methods ON p_name = name
 UNION ALL SELECT 'experiment_' || CAST(o_orderkey AS VARCHAR), 'FROM', 'paper_' || CAST(o_custkey AS VARCHAR), NULL, NULL FROM orders
 UNION ALL SELECT DISTINCT 'experiment_' || CAST(l_orderkey AS VARCHAR), 'EVALUATES', method_id, CASE WHEN l_linestatus = 'O' THEN 'target' ELSE 'baseline' END, CAST(year(l_shipdate) AS VARCHAR) FROM items
 UNION ALL SELECT DISTINCT 'experiment_' || CAST(l_orderkey AS VARCHAR), 'USES', 'dataset_s' || CAST(l_suppkey AS VARCHAR), CASE WHEN l_returnflag = 'R' THEN 'evaluation_data' WHEN l_returnflag = 'A' THEN 'training_data' END, CAST(year(l_shipdate) AS VARCHAR) FROM items)"""
_MENTIONS = """mentions AS (
 SELECT 'paper_' || CAST(doc_id AS VARCHAR) AS paper_id, CAST(pos - 1 AS BIGINT) AS ref_seq, raw, array_to_string(string_split(raw, ' ')[1:4], ' ') AS title,
 CAST(1990 + doc_id % 30 AS VARCHAR) AS year, CASE WHEN length(raw) > 60 THEN 'high' ELSE 'low' END AS confidence
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)
 WHERE regexp_matches(raw, '[A-Za-z]+ [A-Za-z]+ [A-Za-z]+'))"""
_BLOCKS = """blocks AS (
 SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) AS idx,
 CASE WHEN l_returnflag = 'R' THEN 'image' WHEN l_returnflag = 'A' THEN 'caption' ELSE 'text' END AS type,
 (l_quantity % 10) / 20 AS x0, (l_partkey % 20) / 40.0::DOUBLE AS y0, (l_quantity % 10) / 20 + 0.1::DOUBLE + l_discount * 3 AS x1, (l_partkey % 20) / 40.0::DOUBLE + 0.1::DOUBLE + l_tax * 3 AS y1,
 l_linestatus = 'O' AS merge_prev FROM lineitem)"""

CTES = {"methods": _METHODS, "nodes": f"{_METHODS}, {_NODES}", "keys": f"{_METHODS}, {_NODES}, {_KEYS}", "edges": f"{_METHODS}, {_EDGES}", "graph": f"{_METHODS}, {_NODES}, {_KEYS}, {_EDGES}", "mentions": _MENTIONS, "blocks": _BLOCKS}


def oracle(ctes: str, body: str) -> str:
    """A DuckDB statement over the named adapters; body may begin with further CTEs after a comma."""
    return f"WITH {CTES[ctes]} {body}" if ctes else body
