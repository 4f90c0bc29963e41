"""Settings of spark-submit survive, numbering works over ranges, and expansion grows with ids."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyspark
from pyspark.sql import functions as F

from quillmesh.operators import graph as g
from quillmesh.sources import adapters as a

ROOT = Path(__file__).resolve().parent.parent


def test_submitted_settings_are_kept(tmp_path):
    script = tmp_path / "app.py"
    script.write_text("from quillmesh.session import get_session\ns = get_session('x', '4', **{'spark.sql.ansi.enabled': 'false'})\nc = s.sparkContext.getConf()\nprint('SET', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), c.get('spark.driver.memory'), s.conf.get('spark.sql.session.timeZone'), s.conf.get('spark.sql.ansi.enabled'))\n")
    submit = Path(pyspark.__file__).parent / "bin" / "spark-submit"
    env = {**os.environ, "PYTHONPATH": f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable, "PYSPARK_DRIVER_PYTHON": sys.executable, "SPARK_HOME": str(Path(pyspark.__file__).parent)}
    for key in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_MASTER"):
        env.pop(key, None)
    out = subprocess.run(["bash", str(submit), "--master", "local[2]", "--driver-memory", "1g", "--conf", "spark.sql.shuffle.partitions=77", str(script)], capture_output=True, text=True, env=env, timeout=180, check=False)
    assert "SET local[2] 77 1g UTC false" in out.stdout, out.stderr[-2000:]


def test_methods_are_numbered_in_order(spark):
    names = a.methods(spark, "/root/testdata/sf0.001").collect()
    assert [r.method_id for r in sorted(names, key=lambda r: r.name)] == [f"method_{i:04}" for i in range(1, len(names) + 1)]


def test_allocation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(g, "RANGE_ROWS", 10)
    batch = spark.range(300).select(F.when(F.col("id") % 10 < 8, "a").otherwise("b").alias("kind"), F.col("id").alias("pos"))
    got = g.allocate(batch, spark.createDataFrame([("a", 5)], "kind string, last_number long"), F.col("kind")).collect()
    for kind, first in (("a", 6), ("b", 1)):
        own = [r.new_id for r in sorted((r for r in got if r.kind == kind), key=lambda r: r.pos)]
        assert own == [f"{kind}_{first + i:04}" for i in range(len(own))]


def test_levels_grow_with_ids_and_circles_end(spark):
    """A ladder of diamonds has 2^depth paths; each id is there once at its least depth."""
    edges = [(f"{side}{i + 1}", "PART_OF", f"{x}{i}") for i in range(12) for side in "ab" for x in "ab"] + [("a0", "PART_OF", "a12")]
    found = g.expand_down(spark.createDataFrame([("a0",)], "id string"), spark.createDataFrame(edges, "src string, type string, dst string"), depth=14)
    got = {r.id: r.depth for r in found.collect()}
    assert got == {"a0": 0, **{f"{s}{i}": i for i in range(1, 13) for s in "ab"}}
    assert found.count() == 25
