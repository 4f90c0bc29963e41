"""Queries that write records and read them back, and of folders of papers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.session import scratch, table
from quillmesh.sources import folders, sinks


def sk3_yaml(spark, sf_dir):
    """Orders as YAML with nested fields, nulls and lists, as it is read back."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_custkey % 3 > 0 THEN concat('\"', o_orderpriority, '\\\\') END AS `no`", "CASE WHEN o_orderkey % 5 > 0 THEN named_struct('late', o_orderkey % 2 = 0, 'tags', transform(sequence(1, 1 + int(o_orderkey % 3)), i -> concat(o_orderstatus, i))) END AS about", "cast(array() AS array<int>) AS refs")
    path = scratch(spark, "yaml")
    sinks.write_yaml(o, path)
    lines = spark.read.option("lineSep", "\n-").text(path).select(F.concat(F.when(F.col("value").startswith("-"), "").otherwise("-"), F.rtrim("value")).alias("yaml"))
    return lines.select(F.regexp_extract("yaml", r"id: (\d+)", 1).cast("long").alias("id"), F.regexp_replace("yaml", r"\s+$", "").alias("yaml"))


_SK3_YAML = """SELECT o_orderkey AS id, '-' || chr(10) || '  id: ' || o_orderkey || chr(10) || '  "no": ' || CASE WHEN o_custkey % 3 > 0 THEN '"\\"' || o_orderpriority || '\\\\"' ELSE 'null' END || chr(10) || '  about:' || CASE WHEN o_orderkey % 5 > 0 THEN chr(10) || '    late: ' || (o_orderkey % 2 = 0) || chr(10) || '    tags:' || array_to_string(list_transform(range(1, 2 + o_orderkey % 3), lambda i: chr(10) || '      - "' || o_orderstatus || i || '"'), '') ELSE ' null' END || chr(10) || '  refs: []' AS yaml FROM orders"""


def sk3_files(spark, sf_dir):
    """One Markdown file a supplier, in a folder of its nation, as it is read back."""
    files = table(spark, sf_dir, "supplier").selectExpr("concat('n', s_nationkey, '/s', s_suppkey, '.md') AS name", "concat('# ', s_name, char(10), s_acctbal > 0, ' é') AS content")
    path = scratch(spark, "files")
    sinks.write_files(files, path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), "length", F.md5("content").alias("md5"))


_SK3_FILES = "WITH f AS (SELECT *, '# ' || s_name || chr(10) || (s_acctbal > 0) || ' é' AS content FROM supplier) SELECT 'n' || s_nationkey || '/s' || s_suppkey || '.md' AS name, CAST(octet_length(encode(content)) AS BIGINT) AS length, md5(content) AS md5 FROM f"

_ROOT = "concat('/in/r', doc_id % 60)"
#: Where a document lies below its root; it has a list, a text under its paper's name or another one, or a picture.
_FOLDER = "CASE WHEN doc_id % 60 < 20 AND doc_id % 7 = 0 THEN 'vlm/' WHEN doc_id % 60 BETWEEN 10 AND 30 AND doc_id % 5 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'deep/er/vlm/' ELSE concat('p', doc_id % 3, '/vlm/') END"
_NAME = "CASE doc_id % 4 WHEN 0 THEN concat('d', doc_id, '_content_list.json') WHEN 1 THEN concat('d', doc_id, '.md') WHEN 2 THEN concat('p', doc_id % 3, '.md') ELSE 'x.png' END"


def sc4(spark, sf_dir):
    """Documents as files below sixty roots, of which some have a folder of their own, files of their own, or folders of papers."""
    return folders.paper_folders(table(spark, sf_dir, "documents").selectExpr(f"{_ROOT} AS root", f"concat({_FOLDER}, {_NAME}) AS path"))


_SC4 = f"""WITH f AS (SELECT {_ROOT} AS root, rtrim({_FOLDER}, '/') AS folder, {_NAME} AS name FROM documents), k AS (SELECT *, bool_or(folder = 'vlm') OVER r AS vlm, bool_or(folder = '' AND name <> 'x.png') OVER r AS own FROM f WINDOW r AS (PARTITION BY root)),
w AS (SELECT *, CASE WHEN vlm THEN split_part(root, '/', 3) WHEN own THEN 'in' ELSE split_part(folder, '/', 1) END AS paper_id FROM k WHERE CASE WHEN vlm THEN folder = 'vlm' WHEN own THEN folder = '' ELSE folder LIKE 'p_/vlm' END)
SELECT root, folder, paper_id, min(name) FILTER (name LIKE '%json') AS content_list, coalesce(min(name) FILTER (name = paper_id || '.md'), min(name) FILTER (name LIKE '%.md')) AS markdown FROM w GROUP BY root, folder, paper_id"""

QUERIES = {"sc4_paper_folders": (sc4, _SC4), "sk3_yaml_records": (sk3_yaml, _SK3_YAML), "sk3_record_files": (sk3_files, _SK3_FILES)}
