"""Channels cut to their best agree with scoring every pair of query and node, and many equal texts are scored as one."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from quillmesh.operators import retrieval as r

SECONDS = 60
WORDS = ("ring", "rings", "bolt", "7", "71", "large")


def _tables(spark):
    word = lambda c: F.element_at(F.array(*[F.lit(w) for w in WORDS]), (c % len(WORDS) + 1).cast("int"))
    i = F.col("id")
    nodes = spark.range(300).select(F.format_string("n%03d", i).alias("id"), F.concat_ws(" ", word(i), word(F.floor(i / 6))).alias("raw"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (i % 3 + 1).cast("int")).alias("kind"))
    nodes = nodes.unionByName(nodes.select("id", F.lit("bolt").alias("raw"), "kind"))  # a second name
    asked = spark.range(40).select(i.alias("q"), F.concat_ws(" ", word(i), F.when(i % 2 == 0, word(i * 5 + 1))).alias("text"), F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").alias("wanted"))
    return nodes, asked.unionByName(spark.createDataFrame([(90, "", None), (91, None, "a")], "q long, text string, wanted string"))


def _cut(scored, asked, nodes, n):
    kinds = nodes.select("id", "kind").distinct()
    return r.top(scored.join(asked.select("q", "wanted"), "q").join(kinds, "id").filter("wanted is null or wanted = kind").select("q", "id", "score"), n)


def _rows(df):
    return sorted((x["q"], x["id"], round(x["score"], 6)) for x in df.select("q", "id", "score").collect())


def test_names_cut_as_all_pairs(spark):
    nodes, asked = _tables(spark)
    assert _rows(r.lexical_top(asked, nodes, 4)) == _rows(_cut(r.lexical_name(asked, nodes.select("id", "raw")), asked, nodes, 4))


def test_names_that_meet_the_same_terms_are_scored_once(spark):
    """200 queries over 300,000 names, each of which every query meets by its first word: 60,000,000 pairs where each name was scored by itself."""
    names = spark.range(300_000).select(F.format_string("n%06d", "id").alias("id"), F.format_string("s2 %06d", "id").alias("raw"), F.lit("a").alias("kind"))
    asked = spark.range(200).select(F.col("id").alias("q"), F.format_string("s2 long%03d", "id").alias("text"), F.lit(None).cast("string").alias("wanted"))
    start = time.perf_counter()
    got = r.lexical_top(asked, names, 3).groupBy("id").agg(F.count("q"), F.round(F.min("score"), 4), F.round(F.max("score"), 4)).collect()
    assert sorted(map(tuple, got)) == [(f"n{i:06}", 200, 2.8284, 2.8284) for i in range(3)]
    assert time.perf_counter() - start < SECONDS


def test_texts_cut_as_all_pairs(spark):
    nodes, asked = _tables(spark)
    texts = nodes.filter("raw <> 'bolt'").select("id", F.col("raw").alias("text"), "kind").dropDuplicates(["id"])
    assert _rows(r.bm25_top(asked, texts, 4)) == _rows(_cut(r.bm25(asked, texts.select("id", "text")), asked, texts, 4))


def test_holders_are_gathered_once(spark):
    nodes = spark.range(50).select(F.format_string("n%03d", "id").alias("id"), F.lit("K").alias("kind"), F.array(F.lit("url:x")).alias("identifiers"))
    keys = nodes.select(F.lit("m|K|global").alias("key"), F.lit("ambiguous").alias("status"), F.col("id").alias("object_id"))
    queries = spark.range(30).select(F.col("id").alias("q"), F.lit("url:x").alias("identifier"), F.lit("m").alias("mention"), F.lit("K").alias("kind"), F.lit("read").alias("mode"))
    found = r._hits(queries, nodes, keys, "global")
    assert [(len(x["h"]), len(x["a"]), x["key_status"]) for x in found.collect()] == [(50, 50, "ambiguous")] * 30


def test_lists_of_holders_do_not_travel_with_the_queries(spark):
    """30 queries for an identifier of 50 nodes and a key of 40: what is shuffled and decided holds counts, and each list is there once."""
    nodes = spark.range(50).select(F.format_string("n%03d", "id").alias("id"), F.lit("K").alias("kind"), F.array(F.lit("url:x")).alias("identifiers"), F.lit("x").alias("description"))
    keys = nodes.filter("id >= 'n010'").select(F.lit("m|K|global").alias("key"), F.lit("m").alias("raw"), F.lit("ambiguous").alias("status"), F.col("id").alias("object_id"))
    queries = spark.range(30).select(F.col("id").alias("q"), F.when(F.col("id") < 20, "url:x").alias("identifier"), F.lit("m").alias("mention"), F.lit("K").alias("kind"), F.lit("read").alias("mode"))
    rows, lists = r._counts(queries, nodes, keys, "global")
    assert not [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    assert {(x["n_h"], x["n_a"], x["n_both"], x["first_both"]) for x in rows.collect()} == {(50, 40, 40, "n010"), (0, 40, 0, None)}
    assert sorted(len(x["refs"]) for x in lists.collect()) == [40, 50]
    got = {(x["stage"], x["status"], len(x["refs"]), x["refs"][0]) for x in r.resolve(queries, nodes, keys).collect()}
    assert got == {("id", "ambiguous", 50, "n000"), ("alias", "ambiguous", 40, "n010")}


def test_a_word_does_not_carry_its_text(spark):
    """The array of words is counted below the explode: carried along, a long text would be copied for each of its words."""
    import re

    from quillmesh.operators.text_index import words_of

    texts = spark.createDataFrame([(1, "rings and bolts " * 3)], "id long, text string")
    plan = words_of(texts, "id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Generate explode\(words#\d+\), \[id#\d+L, len#\d+\]", plan), plan
    assert words_of(texts, "id").groupBy("len").count().collect()[0][:] == (6, 6)
