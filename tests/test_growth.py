"""Work that grows with the input and not with its square: large groups within a bounded time."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from quillmesh.operators import bibliography, graph, papers

SECONDS = 60


def test_a_long_reference_list_is_read_in_linear_time(spark):
    n = 40_000
    plain = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Ann, B. ("), (1900 + i % 100).cast("string"), F.lit("). Title.")))
    spaced = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array(F.lit(" "), F.concat(F.lit("Bo, C. "), (1900 + i % 100).cast("string")), F.lit("more"))))
    start = time.perf_counter()
    got = spark.range(1).select(papers.markdown_references(plain).alias("a"), papers.markdown_references(spaced).alias("b")).select(F.size("a"), F.size("b"), F.col("a")[n - 1], F.col("b")[0]).first()
    assert tuple(got) == (n, n, f"Ann, B. ({1900 + n % 100}). Title.", "Bo, C. 1901 more")
    assert time.perf_counter() - start < SECONDS


def test_pieces_of_a_reference_list_keep_their_entries(spark):
    lines = ["", "not a start", "Ann, B. Title 1999", "Bo, C. (2001) more.", "Cy, D. word-", "1984.", "Dee, E. 2003.", "tail.", None, "Eve, F. no year", "", "Fay, G. 2004"]
    got = spark.createDataFrame([(lines,)], "l array<string>").select(papers.markdown_references(F.col("l"))).first()[0]
    assert got == ["not a start Ann, B. Title 1999 Bo, C. (2001) more. Cy, D. word- 1984.", "Dee, E. 2003. tail. Eve, F. no year", "Fay, G. 2004"]


def test_many_citations_of_one_surname_and_year(spark):
    n = 40_000
    key = [F.lit(1).alias("paper"), F.lit("lee").alias("surname")]
    citations = spark.range(n).select(F.col("id").alias("citation"), *key, F.when(F.col("id") % 2 == 0, "2001a").otherwise("2001c").alias("year"))
    references = spark.range(n).select(F.col("id").alias("ref"), *key, F.when(F.col("id") % 2 == 0, "2001b").otherwise("2001a").alias("year"))
    start = time.perf_counter()
    found = bibliography.cited_references(citations, references).groupBy("rung", "n_refs", "first_ref").count().collect()
    assert {tuple(r) for r in found} == {(1, n // 2, 1, n // 2), (2, n, 0, n // 2)}
    assert time.perf_counter() - start < SECONDS


def test_a_citation_of_several_rows_counts_each_reference_once(spark):
    citations = spark.createDataFrame([(1, 1, "lee", "2001a"), (1, 1, "kim", "2001a"), (1, 1, "kim", "2001a"), (2, 1, "lee", "2001c"), (2, 1, "lee", "2001d"), (3, 1, "lee", None), (None, 1, "lee", "2001a"), (4, 1, "lee", "2001b")], "citation int, paper int, surname string, year string")
    references = spark.createDataFrame([(7, 1, "lee", "2001a"), (7, 1, "kim", "2001a"), (8, 1, "lee", "2001b"), (9, 1, "lee", None)], "ref int, paper int, surname string, year string")
    got = {tuple(r) for r in bibliography.cited_references(citations, references).collect()}
    assert got == {(1, 1, 1, 7), (2, 2, 2, 7), (None, 1, 1, 7), (4, 1, 1, 8)}


def test_experiments_meet_their_datasets_once(spark):
    edges = [("e1", "EVALUATES", "m", None), ("e1", "USES", "d", "evaluation_data"), ("e1", "USES", "p", "evaluation_data"), ("e1", "USES", "d", None), ("e1", "USES", "d", "training_data"), ("e2", "EVALUATES", "m", None), ("e2", "USES", "p", None), ("e2", "EVALUATES", "m", None)]
    e = spark.createDataFrame(edges, "src string, type string, dst string, role string")
    data = spark.createDataFrame([("r", "d", 0), ("r", "p", 1), ("p", "p", 0)], "root string, id string, depth int")
    found = graph.experiments(spark.createDataFrame([("m",), ("m",)], "id string"), e, data)
    assert sorted((x.root, x.bucket, x.experiment, x.dataset) for x in found.collect()) == [("p", "matched", "e1", "p"), ("p", "role_missing", "e2", "p"), ("r", "expandable", "e1", "p"), ("r", "matched", "e1", "d"), ("r", "role_missing", "e1", "d"), ("r", "role_missing", "e2", "p")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3  # subjects, datasets, and both sides; nine where each bucket made its own


def test_members_are_worked_out_once(spark):
    rows = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        rows.add(1)
        return x

    n = 200
    members = spark.range(n).select(F.lit("m").alias("method"), F.lit("1996").alias("version"), seen(F.format_string("p%04d", "id")).alias("paper"), F.lit(1).alias("target"), (F.col("id") % 2).cast("int").alias("baseline"))
    want = sum(1 for i in range(n) for j in range(i + 1, n) if j % 2)
    assert graph.shared_counts(members).select("n_pairs").first()[0] == want and rows.value == n
    assert graph.shared_pairs(members).count() == want and rows.value == 2 * n
