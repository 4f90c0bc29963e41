"""YAML that a YAML reader reads back, and files that appear all at once or not at all."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quillmesh.sources import sinks


def test_yaml_is_read_back(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    kind = "id bigint, name string, yes boolean, `odd: key` string, x double, tags array<string>, inner struct<a:int,b:array<struct<c:string,d:array<int>>>>, m map<string,array<int>>, day date, nothing struct<a:int>"
    import datetime

    rows = [
        (1, 'a "q" \\ # : - é\n\ttwo', True, "true", 0.5, ["1", None, "", "- x"], (1, [("c", [1, 2]), ("d", []), None]), {"k": [1], "no": None, "a b": []}, datetime.date(2024, 1, 2), None),
        (None, None, None, "null", float("inf"), [], (None, []), {}, None, (None,)),
        (3, "~", False, "", -1e300, None, None, None, None, (7,)),
    ]
    df = spark.createDataFrame(rows, kind).coalesce(1)
    sinks.write_yaml(df, f"{tmp_path}/y")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/y", wholetext=True).collect())
    got = yaml.safe_load(text)
    assert got[0] == {"id": 1, "name": rows[0][1], "yes": True, "odd: key": "true", "x": 0.5, "tags": ["1", None, "", "- x"], "inner": {"a": 1, "b": [{"c": "c", "d": [1, 2]}, {"c": "d", "d": []}, None]}, "m": {"k": [1], "no": None, "a b": []}, "day": "2024-01-02", "nothing": None}
    assert got[1] == {"id": None, "name": None, "yes": None, "odd: key": "null", "x": float("inf"), "tags": [], "inner": {"a": None, "b": []}, "m": {}, "day": None, "nothing": {"a": None}}
    assert got[2]["name"] == "~" and got[2]["inner"] is None and float(got[2]["x"]) == -1e300 and got[2]["nothing"] == {"a": 7}


def below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_files_appear_at_once(spark, tmp_path):
    rows = [(f"d{i % 3}/p{i}.md", f"text {i} é") for i in range(40)] + [("./top.md", None)]
    df = spark.createDataFrame(rows, "name string, content string").repartition(6)
    sinks.write_files(df, f"file://{tmp_path}/out")
    assert below(tmp_path / "out") == sorted([n for n, _ in rows[:-1]] + ["top.md"])
    assert (tmp_path / "out/d1/p4.md").read_text() == "text 4 é" and (tmp_path / "out/top.md").read_text() == ""
    with pytest.raises(Exception, match="out"):
        sinks.write_files(df, f"file://{tmp_path}/out")
    sinks.write_files(df.limit(0), f"file://{tmp_path}/none")
    assert os.listdir(tmp_path / "none") == []


@pytest.mark.parametrize("bad", ["boom", None, "", "../x", "d/", "d0/p3.md"])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    rows = [(f"d0/p{i}.md", "x") for i in range(40)] + [(bad, "y")]
    df = spark.createDataFrame(rows, "name string, content string")
    if bad == "boom":
        df = df.withColumn("content", F.when(F.col("name") == "boom", F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception):
        sinks.write_files(df, f"file://{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_a_failed_task_leaves_no_yaml(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("boom")).cast("string")).otherwise("a"))
    with pytest.raises(Exception, match="boom"):
        sinks.write_yaml(df, f"{tmp_path}/y")
    assert [f for f in below(tmp_path / "y") if not f.startswith("_temporary")] == []
