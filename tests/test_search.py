"""The stored text index and Search: equal to scoring everything, with fewer blocks opened; constraints below the scoring."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import retrieval as r
from quillmesh.operators import search as se
from quillmesh.operators.text_index import STOP_WORDS, TextIndex, lengths_of, stemmed, terms_of, words_of
from quillmesh.session import scratch


def test_stems(spark):
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "caress": "caress", "agreed": "agree", "feed": "feed", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflate", "troubled": "trouble", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "as": "as", "12s": "12", "models": "model", "modelling": "modell"}
    got = {x.w: x.s for x in spark.createDataFrame([(w,) for w in want], "w string").select("w", stemmed(F.col("w")).alias("s")).collect()}
    assert got == want


def some_texts(rng, n):
    common = ["data", "model", "score", "the", "and"]
    rare = [f"word{i}" for i in range(120)]
    return [" ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.choice([3, 8, 30, 90]))) for _ in range(n)]


def scored(texts, query):
    words = {i: [w for w in t.split() if w not in STOP_WORDS] for i, t in texts.items() if t}
    words = {i: w for i, w in words.items() if w}
    stem = lambda w: {"models": "model", "scores": "score"}.get(w, w)
    mean = sum(map(len, words.values())) / len(words)
    terms = {stem(w) for w in query.split() if w not in STOP_WORDS}
    out = {}
    for term in terms:
        df = sum(term in w for w in words.values())
        for i, w in words.items():
            if term in w:
                tf = w.count(term)
                out[i] = out.get(i, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return out


@pytest.mark.parametrize("segments,first", [(1, 2), (3, 1)])
def test_top_k_is_exact_and_opens_few_blocks(spark, segments, first):
    rng = random.Random(segments)
    texts = dict(enumerate(some_texts(rng, 900))) | {900: None, 901: "", 902: "the and of"}
    index = TextIndex(spark, scratch(spark, "index"))
    for k in range(segments):
        index.add(spark.createDataFrame([(i, t) for i, t in texts.items() if i % segments == k], "id long, text string"), block=8)
    queries = {1: "word1 word2 models", 2: "data and scores", 3: "word7 word7 word8", 4: "unknown", 5: "", 6: "word3 score"}
    found, report = index.search(spark.createDataFrame(list(queries.items()), "q long, text string"), 5, first=first)
    got = {}
    for x in found.collect():
        got.setdefault(x.q, {})[x.id] = x.score
    for q, text in queries.items():
        want = scored(texts, text)
        best = sorted(want, key=lambda i: (-round(want[i], 6), i))[:5]
        assert set(got.get(q, {})) == set(best) and all(abs(got[q][i] - want[i]) < 1e-5 for i in best)
    opened = {x.q: (x.n_opened, x.n_blocks) for x in report.collect()}
    assert all(a <= b for a, b in opened.values()) and sum(a for a, _ in opened.values()) < sum(b for _, b in opened.values())


def test_terms_are_counted_within_their_row(spark):
    """No word is shuffled to be counted, and a text of 200,000 words takes no longer for its length than many short ones."""
    texts = [(i, t) for i, t in enumerate(some_texts(random.Random(3), 50))] + [(50, None), (51, ""), (52, "the and of"), (53, " ".join(f"models word{i % 977}" for i in range(100_000)))]
    d = spark.createDataFrame(texts, "id long, text string")
    found = terms_of(d, "id")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    start = time.perf_counter()
    got = Counter(tuple(x) for x in found.collect())
    assert time.perf_counter() - start < 60
    assert got == Counter(tuple(x) for x in words_of(d, "id").groupBy("id", "len", "term").count().collect())
    assert {tuple(x) for x in lengths_of(d, "id").collect()} == {(x.id, x.len) for x in words_of(d, "id").select("id", "len").distinct().collect()}


def test_allowed_documents_and_unfinished_segments(spark):
    rng = random.Random(7)
    texts = dict(enumerate(some_texts(rng, 300)))
    path = scratch(spark, "index")
    index = TextIndex(spark, path)
    index.add(spark.createDataFrame(list(texts.items()), "id long, text string"), block=8)
    before = index.table("postings").count()
    index.table("postings").limit(3).drop("segment").write.parquet(f"{path}/postings/segment=broken")  # a writer that died before its statistics
    assert index.table("postings").count() == before
    queries = spark.createDataFrame([(1, "data word1"), (2, "model score word2")], "q long, text string")
    allowed = spark.createDataFrame([(1, i) for i in range(0, 300, 7)] + [(2, i) for i in range(3)], "q long, id long")
    got = {(x.q, x.id) for x in index.search(queries, 4, allowed, first=1)[0].collect()}
    for q, text, ok in ((1, "data word1", set(range(0, 300, 7))), (2, "model score word2", {0, 1, 2})):
        want = {i: s for i, s in scored(texts, text).items() if i in ok}
        assert {i for k, i in got if k == q} == set(sorted(want, key=lambda i: (-round(want[i], 6), i))[:4])


def test_constraints_come_first(spark):
    """The best of the feasible, though hundreds of others score higher; the filter lies below the scoring; circles end."""
    docs = [(str(i), "data model" if i < 400 else "data and much other text besides it", "A" if i % 2 else "B") for i in range(420)]
    nodes = spark.createDataFrame([(i, k) for i, _, k in docs], "id string, kind string")
    edges = spark.createDataFrame([(str(i), "FROM", "leaf") for i in range(400, 420)] + [("leaf", "PART_OF", "mid"), ("mid", "PART_OF", "top"), ("top", "PART_OF", "leaf")] + [(str(i), "FROM", "else") for i in range(400)], "src string, type string, dst string")
    index = TextIndex(spark, scratch(spark, "index"))
    index.add(spark.createDataFrame([(i, t) for i, t, _ in docs], "id string, text string"))
    queries = spark.createDataFrame([(1, "data model", None, "A"), (2, None, None, "B"), (3, "data", None, None), (4, "data", None, "C")], "q long, text string, embedding array<double>, kind string")
    wanted = spark.createDataFrame([(1, "FROM", "top"), (2, "FROM", "mid")], "q long, type string, dst string")
    vectors = spark.createDataFrame([], "id string, embedding array<double>")
    ask = lambda depth: se.search(queries, nodes, edges, wanted, index, vectors, pool=6, n=4, depth=depth)
    got = {}
    for x in ask(5).collect():
        got.setdefault(x.q, []).append(x)
    assert {x.id for x in got[1]} == {"401", "403", "405", "407"} and {x.witnesses for x in got[1]} == {"FROM=leaf"}
    assert [x.id for x in sorted(got[2], key=lambda x: x.place)] == ["400", "402", "404", "406"] and got[2][0].n_feasible == 10
    assert (got[3][0].n_feasible, got[3][0].truncated, len(got[3])) == (420, True, 4) and 4 not in got
    assert {x.q for x in ask(0).collect()} == {3}
    allowed = se.feasible(queries, nodes, edges, se.expanded(wanted, edges, "PART_OF", 2))
    asked = index.asked(queries.filter("text is not null").select("q", "text"))
    plan = index.scores(asked, index.bounds(asked), lambda rows: rows.join(allowed, ["q", "id"], "left_semi"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Aggregate") < plan.index("LeftSemi")


@pytest.mark.parametrize("pool,most", [(3, 10_000), (5, 4), (200, 10_000)])
def test_nearest_vectors_are_exact(spark, monkeypatch, pool, most):
    monkeypatch.setattr(r, "MOST_QUERIES", most)
    monkeypatch.setattr(r, "CELLS", 50)
    rng = random.Random(pool)
    items = [(i, [round(rng.gauss(0, 1), 1) for _ in range(3)]) for i in range(80)] + [(100 + i, [1.0, 0.0, 0.0]) for i in range(40)] + [(200, None)]
    d = spark.createDataFrame(items, "id long, embedding array<double>").repartition(3)
    queries = d.filter("id % 20 = 0").withColumnRenamed("id", "q")
    got = Counter((x.q, x.id) for x in r.semantic(queries, d, pool).collect())
    unit = {i: [c / (math.hypot(*v) or 1) for c in v] if v else [0, 0, 0] for i, v in items}
    for q in [i for i, _ in items if i % 20 == 0]:
        sims = {i: round((1 + sum(a * b for a, b in zip(unit[q], v, strict=True))) / 2, 9) for i, v in unit.items()}
        assert {i for k, i in got if k == q} == set(sorted(sims, key=lambda i: (-sims[i], i))[:pool])
    assert r.semantic(queries.limit(0), d, pool).collect() == []
