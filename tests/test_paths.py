"""Paths over shared methods, as groups and as pairs, with a method that a third of all edges have."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
from oracle import connection, differences

from quillmesh.operators import graph as g
from quillmesh.plans.graph_queries import QUERIES


def test_groups_equal_pairs(spark, monkeypatch):
    monkeypatch.setattr(g, "RANGE_ROWS", 7)
    rng = random.Random(4)
    edges = [(f"e{i}", "FROM", f"p{rng.randrange(60):02}", None, None) for i in range(400)]
    for i in range(400):
        method = "hub" if rng.random() < 0.35 else f"m{rng.randrange(9)}"
        edges.append((f"e{i}", "EVALUATES", method, rng.choice(["target", "baseline", None]), rng.choice(["1", "2", None])))
    d = spark.createDataFrame(edges, "src string, type string, dst string, role string, version string")
    paper = {s: o for s, t, o, _, _ in edges if t == "FROM"}
    sides = {}
    for s, t, o, role, v in edges:
        if t == "EVALUATES" and role:
            sides.setdefault((o, v), {}).setdefault(role, set()).add(paper[s])
    want = {k: [(p, q) for p in x.get("target", ()) for q in x.get("baseline", ()) if p < q] for k, x in sides.items()}
    members = g.shared_members(d)
    counts = {(r.method, r.version): (r.n_targets, r.n_baselines, r.n_pairs) for r in g.shared_counts(members).collect()}
    assert counts == {k: (len(x.get("target", ())), len(x.get("baseline", ())), len(want[k])) for k, x in sides.items()}
    most = sorted(len(w) for w in want.values())[-2]
    pairs = Counter((r.method, r.version, r.paper, r.other) for r in g.shared_pairs(members, most).collect())
    assert pairs == Counter((*k, p, q) for k, w in want.items() if len(w) <= most for p, q in w)
    assert any(k[0] == "hub" and len(w) > most for k, w in want.items())


def test_pairs_of_large_groups_are_counted_and_written(spark, monkeypatch):
    """A group of 62,500 pairs, beyond the 20,000 at which groups were once left out."""
    monkeypatch.setattr(g, "RANGE_ROWS", 50)
    monkeypatch.setattr(g, "BLOCK_PAPERS", 60)
    edges = [(f"e{i}", "FROM", f"p{i:03}", None, None) for i in range(500)]
    edges += [(f"e{i}", "EVALUATES", "m", "target" if i < 250 else "baseline", None) for i in range(500)]
    edges += [("e9", "EVALUATES", "n", "target", "1"), ("e8", "EVALUATES", "n", "baseline", "1"), ("e10", "EVALUATES", "n", "baseline", "1")]
    members = g.shared_members(spark.createDataFrame(edges, "src string, type string, dst string, role string, version string"))
    got = {tuple(r) for r in g.shared_by_paper(members).collect()}
    assert got == {("m", None, f"p{i:03}", 250, "p499") for i in range(250)} | {("n", "1", "p009", 1, "p010")}
    pairs = g.shared_pairs(members)
    assert pairs.count() == 62_501 == pairs.distinct().count()


def test_shared_pairs_query_has_groups_of_many_pairs(spark, tmp_path):
    """The seven groups of one method at sf0.1, each of over 20,000 pairs: the query once left all of them out."""
    for t in ("part", "supplier", "nation", "customer", "orders"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.1/{t}.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT l.* FROM '/root/testdata/sf0.1/lineitem.parquet' l JOIN '/root/testdata/sf0.1/part.parquet' ON l_partkey = p_partkey WHERE p_name = 'large ring') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con = connection(str(tmp_path))
    counts, pairs = (QUERIES[f"jn8_shared_{x}"] for x in ("counts", "pairs"))
    sizes = con.execute(f"SELECT n_pairs FROM ({counts[1]})").fetchall()
    assert len(sizes) >= 6 and min(sizes)[0] > 20_000
    assert differences(pairs[0](spark, str(tmp_path)), con, pairs[1]) == []


def test_pairs_of_one_method_are_spread_and_written_once(spark, monkeypatch):
    monkeypatch.setattr(g, "BLOCK_PAPERS", 5)
    rng = random.Random(5)
    edges = [(f"e{i}", "FROM", f"p{rng.randrange(40):02}", None, None) for i in range(500)]
    edges += [(f"e{i}", "EVALUATES", rng.choice(["m", "n"]), rng.choice(["target", "baseline", None]), rng.choice(["1", "2", "3", None])) for i in range(500)]
    paper = {s: o for s, t, o, _, _ in edges if t == "FROM"}
    side = lambda role: {(v, paper[s]) for s, t, o, r, v in edges if t == "EVALUATES" and o == "m" and r == role and v}
    want = {(p, q) for v, p in side("target") for w, q in side("baseline") if v == w and p < q}
    pairs = g.papers_by_shared_method(spark.createDataFrame(edges, "src string, type string, dst string, role string, version string"), "m")
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "block" in plan  # pairs are not gathered again, and a version is not one key
