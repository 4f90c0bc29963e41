"""Golden and awkward cases: nulls, empties, ties, repeats, long inputs, deep levels, long chains and malformed files."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import html_text as ht
from quillmesh.functions import json_text as js
from quillmesh.functions import markdown as md
from quillmesh.functions import text as t
from quillmesh.operators import anchors, bibliography, commit, graph, reports, retrieval
from quillmesh.sources import files


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], schema).select(column.alias("v")).first().v


def test_html_golden_cases():
    assert ht.read("<title> A\n b </title><script>x<p>y</script><h2>Head <i>it</i></h2>pre<p>One <b>two</b><br>three &amp; <a href='/u'>link</a><p>open") == ("A b", ["## Head *it*", "pre", "One **two**\nthree & [link](/u)", "open"])
    assert ht.read("<ul><li>a<li>b</ul><pre>x\n  y</pre>") == ("", ["- a", "- b", "```\nx\n  y\n```"])
    assert ht.read("<table><tr><th colspan=2>H<td>z<tr><td rowspan=2>a|b<td>c<tr><td>d</table>")[1] == ["| H |  | z |\n| --- | --- | --- |\n| a\\|b | c |  |\n|  | d |  |"]
    assert ht.table_grid([[("a", 2, 1), ("b", 1, 2)], [("c", 1, 1)]]) == [["a", "b", ""], ["", "c"]]
    assert ht.read(None) == ("", []) and ht.read("<p>" * 5000 + "x")[1] == ["x"]
    assert [(s["level"], s["title"], s["text"]) for s in ht.sections(["a", "# T", "b", "c"])] == [(0, "", "a"), (1, "T", "b\n\nc")]


def test_html_columns(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<title>t</title><h1>x</h1>y")], "id int, html string")
    assert [tuple(r) for r in rows.select(ht.html_to_markdown(F.col("html"))).collect()] == [(None,), ("",), ("# x\n\ny",)]
    got = [r.p for r in rows.select(ht.html_sections(F.col("html")).alias("p")).collect()]
    assert got[0].sections is None and got[1].sections == [] and got[2].title == "t" and got[2].sections[0].text == "y"


def test_json_helpers():
    assert list(js.walk({"a": ["x", {"caption": ["y"]}], "b": 1}, False)) == ["x", "y"] and list(js.walk({"a": "x", "Caption": {"k": "y"}}, True)) == ["y"]
    assert js.first_object('x {"a": 1} {"a": {"b": 2}, "c": 3}', ("a", "c")) == '{"a":{"b":2},"c":3}'
    assert js.first_object(None, ("a",)) is None and js.first_object("{" * 300, ("a",)) is None


def fold(candidates):
    """Reference repair line by line."""
    year = re.compile(r"\b(?:19|20)\d{2}[a-z]?\b")
    entries, current, joined = [], "", 0
    for line in candidates:
        line = " ".join(line.split())
        if not line:
            continue
        done = bool(current) and bool(year.search(current)) and current.rstrip()[-1] in '.!?)]"'
        start = re.match(r"(?:\d+\. *)?[A-Z][a-z]+", line) and (year.search(line) or "," in line[:180] or " and " in line[:180])
        if current and done and start:
            entries.append(current)
            current = line
        elif current:
            joined += not done
            current = current[:-1] + line if re.search("[A-Za-z]-$", current) and re.match("[a-z]", line) else f"{current} {line}"
        else:
            current = line
    entries += [current] if current else []
    return list(dict.fromkeys(entries)), joined


def test_reference_repair_is_the_fold(spark):
    rng = random.Random(3)
    pool = ["Smith, A. and Lee, B. 1999. A title.", "Doe, J. 2001. An unfin-", "ished title. In X.", "", "  Kim, C. and Wu, D.", "2010. Late year.", "no start here", "Smith, A. and Lee, B. 1999. A title."]
    cases = [[], [""], *[[rng.choice(pool) for _ in range(rng.randint(1, 9))] for _ in range(40)]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<string>")
    got = {r.i: (r.r.entries, r.r.joined) for r in rows.select("i", reports.repaired_references(F.col("c")).alias("r")).collect()}
    assert got == {i: fold(c) for i, c in enumerate(cases)}


def test_markdown_sections(spark):
    text = "# T\nintro\n## 2. References:\n[1] a\n### Sub\nx\n## Appendix\nend"
    assert one(spark, md.strip_references(F.col("m")), m=("string", text)) == "# T\nintro\n## Appendix\nend"
    assert one(spark, md.strip_references(F.col("m")), m=("string", None)) is None and one(spark, md.strip_references(F.col("m")), m=("string", "")) == ""
    assert [tuple(r) for r in one(spark, md.section_outline(F.col("m")), m=("string", "## A\nx\n# B \n# Bibliography\n# C"))] == [(2, "A", 1), (1, "B", 3)]
    assert one(spark, md.section_text(F.col("m"), "abstract"), m=("string", "# T\n## Abstract\none\n two\n## Next\nx")) == "one two"
    assert one(spark, md.section_text(F.col("m"), "abstract"), m=("string", "no heading")) == ""
    assert one(spark, md.first_heading(F.col("m")), m=("string", None)) == ""
    assert one(spark, md.folded_title(F.col("s")), s=("string", "Straße ﬁ ①-x")) == "strassefi1x" and one(spark, md.folded_title(F.col("s")), s=("string", None)) is None
    lines = F.split("m", "\n")
    assert one(spark, bibliography.reference_lines(lines), m=("string", "a\n# References\nb\nc\n## D\ne")) == ["b", "c"]
    assert one(spark, bibliography.reference_lines(lines), m=("string", "a\nb")) == [] and one(spark, bibliography.reference_lines(lines), m=("string", "References")) == []


def test_deep_levels_and_long_chains(spark):
    h = spark.createDataFrame([(1, i, lvl) for i, lvl in enumerate([1, 9, 8, 12, 2, None, 1])], "doc int, pos int, level int")
    got = {r.pos: (r.end_pos, r.parent_pos) for r in bibliography.section_bounds(h, "doc", "pos", "level").collect()}
    assert got == {0: (6, None), 1: (2, 0), 2: (4, 0), 3: (4, 2), 4: (6, 0), 5: (None, None), 6: (None, None)}
    n = 70
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "id int, into int")
    assert {r.survivor for r in graph.follow_merges(chain).collect()} == {n}
    with pytest.raises(ValueError):
        graph.follow_merges(spark.createDataFrame([(1, 2), (2, 1)], "id int, into int")).collect()


def test_vector_queries_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    items = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "id long, embedding array<double>")
    asked = items.withColumnRenamed("id", "q")
    whole = sorted(map(tuple, retrieval.semantic(asked, items, 3).collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 10)
    assert sorted(map(tuple, retrieval.semantic(asked, items, 3).collect())) == whole and len(whole) == 180
    assert retrieval.semantic(asked.limit(0), items, 3).collect() == []


def test_json_lines(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_text('{"a": 1, "b": "é"}\n\n{"a": null}\n')
    bad.write_text('{"a": 1}\n{"a": \n')
    assert [tuple(r) for r in files.read_jsonl(spark, str(good), "a int, b string").collect()] == [(1, "é"), (None, None)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.read_jsonl(spark, str(bad), "a int").collect()
    with pytest.raises(KeyError):
        files.find_record(files.read_jsonl(spark, str(good), "a int, b string"), "a", 9)


def test_a_batch_that_clashes_changes_nothing(spark):
    nodes = spark.createDataFrame([("x", ["Entity", "Model"], "New", "d", None, ["doi:1"], [], False, True)], "ref string, labels array<string>, name string, text string, direction string, identifiers array<string>, aliases array<string>, own_id boolean, plain boolean")
    rels = spark.createDataFrame([], "a string, type string, c string")
    store = spark.createDataFrame([("model_0001", ["Entity", "Model"], "Old", "d", ["doi:1"])], "id string, labels array<string>, name string, text string, identifiers array<string>")
    keys = spark.createDataFrame([("Old|Model|global", "Old", "active", "model_0001")], "key string, raw string, status string, id string")
    edges = spark.createDataFrame([], "src string, type string, dst string")
    plan = {(r.action, r.what) for r in commit.commit_plan(nodes, rels, store, keys, edges).collect()}
    assert plan == {("node:new", "New"), ("key:new", "New|Model|global"), ("conflict:identifier-taken", "doi:1")}
    with pytest.raises(ValueError, match="identifier-taken"):
        commit.applied(nodes, rels, store, keys, edges, spark.createDataFrame([("Model", 1)], "kind string, last_number long"))
    assert commit.seed_violations(nodes, rels).collect() == []


def test_null_and_empty_inputs_of_rules(spark):
    assert one(spark, anchors.parsed_anchor(F.col("a")), a=("string", None)) is None and one(spark, anchors.parsed_anchor(F.col("a")), a=("string", "p#s:1-x")) is None
    assert one(spark, anchors.read_lines(F.col("a"), F.lit(2), F.lit(1)), a=("string", "x\ny")) == "" and one(spark, anchors.read_lines(F.col("a"), F.lit(1), F.lit(9)), a=("string", None)) == ""
    assert one(spark, anchors.sentence_at(F.col("p"), F.lit(7), F.lit(9)), p=("string", "One. Two three. Four")) == "Two three."
    assert one(spark, anchors.sentence_at(F.col("p"), F.lit(0), F.lit(1)), p=("string", "")) == ""
    assert one(spark, reports.appended(F.col("a"), F.col("b")), a=("array<string>", None), b=("array<string>", ["x", "x"])) == ["x"]
    assert one(spark, reports.beyond_tolerance(F.lit(10), F.col("e")), e=("int", None)) is False
    assert one(spark, reports.front_matter(F.col("i"), F.col("w")), i=("string", None), w=("array<string>", None)) is True
    assert one(spark, t.normalize_name(F.col("s")), s=("string", "é  x")) == "é x" and one(spark, t.normalize_name(F.col("s")), s=("string", None)) is None


def test_repeated_edges_are_the_same_edges(spark):
    from quillmesh.plans import graph_queries as gq
    from quillmesh.sources import adapters as a

    sf_dir = "/root/testdata/sf0.001"
    once, repeated = a.edges(spark, sf_dir), a.edges(spark, sf_dir, repeated=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, repeated.distinct().collect()))
    # the counts of AG18 do not need each edge once: no step gathers whole edges, with their years
    plan = gq.QUERIES["ag18_integrity"][0](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "year(" not in plan
