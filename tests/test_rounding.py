"""Distances that are equal but for rounding are compared as the SQL compares them."""

from __future__ import annotations

import duckdb
from oracle import differences

from quillmesh.plans import candidate_queries as cq
from quillmesh.plans import page_queries as pq

# An image, its caption and a table: the two centres lie equally far from the caption's, but for the last bit.
ORDER = 118725


def test_equal_centres_round_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_orderkey IN ({ORDER}, 119849, 135734)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    f, sql = cq.QUERIES["jn19_visual_parents"]
    got = sorted(tuple(r) for r in f(spark, str(tmp_path)).select("doc", "idx", "parent").collect())
    assert got == sorted(con.execute(f"SELECT doc, idx, parent FROM ({sql})").fetchall())
    assert (ORDER, 2, 3) in got


def test_shifted_pages_render_as_in_sql(spark, tmp_path):
    """A page of the twentieth copy with shifted keys, where hypot gave a caption to the other of two equally near blocks."""
    n = 19
    con = duckdb.connect()
    shifted = f"l_orderkey + {n * 150_000} AS l_orderkey, l_partkey + {n * 20_000} AS l_partkey, l_suppkey + {n * 1_000} AS l_suppkey"
    con.execute(f"COPY (SELECT * REPLACE ({shifted}) FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_orderkey BETWEEN 31760 AND 31791) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    for name in ("dc7_content_list", "dc7_markdown"):
        f, sql = pq.QUERIES[name]
        assert not differences(f(spark, str(tmp_path)), con, sql), name
