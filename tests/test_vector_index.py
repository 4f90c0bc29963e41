"""Recall of the vector index against the exact search, and exactness when all cells are visited."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import retrieval as r
from quillmesh.operators import vector_index as v
from quillmesh.plans.search_queries import PROBE
from quillmesh.session import scratch, table


def pairs(df):
    return {(x.q, x.id) for x in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    e = table(spark, f"/root/testdata/{sf}", "embeddings").select(F.col("vec_id").alias("id"), "embedding").cache()
    queries = e.filter("id % 20 = 0").withColumnRenamed("id", "q")
    index = v.VectorIndex(spark, scratch(spark, "vectors"))
    index.fit(e)
    index.add(e)
    want, got = pairs(r.semantic(queries, e, 20)), pairs(index.search(queries, e, 20, PROBE))
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_clusters_need_few_cells_and_all_cells_are_exact(spark, monkeypatch):
    monkeypatch.setattr(v, "CHUNK", 50)
    monkeypatch.setattr(v, "TOGETHER", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (20, 12))
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.1, 12)).tolist()) for i in range(1200)] + [(2000 + i, centres[0].tolist()) for i in range(300)] + [(3000, None)]
    e = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    queries = e.filter("id % 30 = 0").withColumnRenamed("id", "q")
    index = v.VectorIndex(spark, scratch(spark, "vectors"))
    index.fit(e, cells=20, sample=500)
    index.add(e.filter("id < 600"))
    index.add(e.filter("id >= 600"))
    want = pairs(r.semantic(queries.filter("embedding is not null"), e.filter("embedding is not null"), 10))
    few, every = pairs(index.search(queries, e, 10, 0.15, 10)), pairs(index.search(queries, e, 10, 1.0, 40))
    assert len(few & want) / len(want) >= 0.9
    assert every == want


def test_candidates_are_reduced_within_tasks(spark, monkeypatch):
    monkeypatch.setattr(v, "CHUNK", 200)
    rng = np.random.default_rng(5)
    e = spark.createDataFrame([(i, rng.normal(0, 1, 8).tolist()) for i in range(2000)], "id long, embedding array<double>").repartition(40)
    index = v.VectorIndex(spark, scratch(spark, "vectors"))
    index.fit(e, cells=4)
    index.add(e)
    cells = spark.read.parquet(f"{index.path}/cells").select("cell", F.size("ids").alias("n")).collect()
    assert sum(c.n for c in cells) == 2000 and len(cells) <= 4 + 2000 // 50  # 160 chunks where each batch files its own
    asked = e.filter("id % 100 = 0").withColumnRenamed("id", "q")
    want = pairs(r.semantic(asked, e, 5))
    assert pairs(index.search(asked, e, 5, 1.0, 8)) == want
    monkeypatch.setattr(v, "HELD", 10)  # what is passed on early is still whole
    assert pairs(index.search(asked, e, 5, 1.0, 8)) == want
