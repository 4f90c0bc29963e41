"""Roles around nodes: each pattern, what depends on what, and what is not asked."""

from __future__ import annotations

import pytest

from quillmesh.operators import roles

NODES = [("m", "Concept", "Method"), ("p", "Entity", "Paper"), ("d", "Entity", "Dataset"), ("e", "Entity", "Experiment"), ("e2", "Entity", "Experiment"), ("u", "Content", "usage"), ("s", "Content", "description"), ("c", "Content", "claim"), ("o", "Entity", "Observation"), ("d1", "Entity", "Dataset"), ("d2", "Entity", "Dataset"), ("t", "Entity", "Protocol")]
EDGES = [("u", "ABOUT", "m"), ("s", "ABOUT", "m"), ("c", "RESPONDS_TO", "m"), ("c", "EXPRESSES", "m"), ("c", "ABOUT", "d"), ("u", "FROM", "p"), ("c", "SUPPORTED_BY", "e2"), ("e", "EVALUATES", "m"), ("e", "USES", "d"), ("e", "USES_PROTOCOL", "t"), ("e", "FROM", "p"), ("d1", "VERSION_OF", "d"), ("d2", "PART_OF", "d1"), ("o", "OBSERVES", "d"), ("o", "CHECKS", "c"), ("o", "USES_PROTOCOL", "t"), ("e", "USES", "d")]


def found(spark, refs, **more):
    nodes, edges = spark.createDataFrame(NODES, "id string, family string, kind string"), spark.createDataFrame(EDGES, "src string, type string, dst string")
    rows = roles.roles_around(spark.createDataFrame([(r,) for r in refs], "id string"), nodes, edges, **more).collect()
    got = {(r.ref, r.role, r.other, r.via, r.way) for r in rows}
    assert len(got) == len(rows)
    return got


def test_all_roles_of_a_concept(spark):
    assert found(spark, ["m", "m"]) == {
        ("m", "definition", "m", None, "self"), ("m", "usage", "u", None, "ABOUT"), ("m", "descriptions", "s", None, "ABOUT"), ("m", "answers", "c", None, "RESPONDS_TO"), ("m", "expressions", "c", None, "EXPRESSES"),
        ("m", "discussed_objects", "m", "u", "ABOUT"), ("m", "discussed_objects", "m", "s", "ABOUT"), ("m", "discussed_objects", "d", "c", "ABOUT"),
        ("m", "experiments", "e", None, "EVALUATES"), ("m", "experiments", "e2", "c", "SUPPORTED_BY"), ("m", "protocol", "t", "e", "USES_PROTOCOL"),
        ("m", "participants", "m", "e", "EVALUATES"), ("m", "participants", "d", "e", "USES"), ("m", "participants", "t", "e", "USES_PROTOCOL"), ("m", "sources", "p", "u", "FROM"), ("m", "sources", "p", "e", "FROM"),
    }


def test_only_what_is_asked_brings_in_records(spark):
    assert found(spark, ["m"], roles=("participants",)) == set()
    assert found(spark, ["m"], roles=("sources", "usage")) == {("m", "usage", "u", None, "ABOUT"), ("m", "sources", "p", "u", "FROM")}
    assert found(spark, ["d"], roles=("checked_claims",)) == {("d", "checked_claims", "c", "o", "CHECKS")}
    assert found(spark, ["d"], roles=("observations", "protocol")) == {("d", "observations", "o", None, "OBSERVES"), ("d", "protocol", "t", "o", "USES_PROTOCOL")}
    assert found(spark, ["c"], roles=("experiments",)) == {("c", "experiments", "e2", "c", "SUPPORTED_BY")}
    assert found(spark, ["e"], roles=("experiments", "participants")) == {("e", "experiments", "e", None, "self"), ("e", "participants", "m", None, "EVALUATES"), ("e", "participants", "d", None, "USES"), ("e", "participants", "t", None, "USES_PROTOCOL")}


def test_depth_and_edges_of_input(spark):
    assert found(spark, ["d", "d1"], roles=("versions", "parts"), depth=2) == {("d", "versions", "d1", None, "VERSION_OF"), ("d1", "parts", "d2", None, "PART_OF")}
    assert found(spark, ["nobody"]) == set() and found(spark, [], roles=("usage",)) == set() and found(spark, ["m"], roles=()) == set()
    with pytest.raises(ValueError, match="moods"):
        found(spark, ["m"], roles=("moods",))


def test_roles_share_joins_and_equal_with_few_and_many_sources(spark, monkeypatch):
    refs = [n[0] for n in NODES]
    few = found(spark, refs, depth=2)
    monkeypatch.setattr(roles, "FEW", -1)
    assert found(spark, refs, depth=2) == few and len(few) > 30
    nodes, edges = spark.createDataFrame(NODES, "id string, family string, kind string"), spark.createDataFrame(EDGES, "src string, type string, dst string")
    plan = roles.roles_around(nodes.select("id"), nodes, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") < 40  # 52 where each role made its own
