"""Sharding, vector codes and spelling variants: brute force, SQL, awkward rows, and what each method promises."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from test_document_operators import corpus, frame

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_sharding", "op12_vector_codes", "op13_spelling"])
def test_agrees_with_sql(spark, name):
    from quillmesh.llm import queries

    assert oracle.differences(queries.queries()[name](spark, SF_DIR), oracle.connection(SF_DIR), queries.oracle_sql()[name]) == []


def test_shards_of_awkward_rows(spark):
    from quillmesh.llm.sharding import shard_digest

    rows = corpus(4, 80)
    got = shard_digest(frame(spark, rows).repartition(3)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 103}) == 1
    assert shard_digest(frame(spark, [])).collect() == []


def test_weights_and_moves(spark):
    from quillmesh.llm.sharding import moves, with_shard

    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    before, after = [1.0, 2.0, 0.0, 1.0], [1.0, 2.0, 0.0, 1.0, 4.0]
    share = {r.shard: r["count"] / 40_000 for r in with_shard(ids, before).groupBy("shard").count().collect()}
    assert set(share) == {0, 1, 3} and all(abs(share[i] - w) < 0.02 for i, w in ((0, 0.25), (1, 0.5), (3, 0.25)))
    moved = {(r.from_shard, r.to_shard): r.n for r in moves(ids, before, after).collect()}
    assert all(a == b or b == 4 for a, b in moved) and abs(sum(n for (a, b), n in moved.items() if b == 4) / 40_000 - 0.5) < 0.02
    heavier = moves(ids, [1.0, 1.0, 1.0], [1.0, 1.5, 1.0]).collect()
    assert all(r.from_shard == r.to_shard or r.to_shard == 1 for r in heavier)  # rows move to the shard that grew alone
    for bad in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            with_shard(ids, bad)


def test_shards_keep_columns_and_other_keys(spark, tmp_path):
    from quillmesh.llm.sharding import with_shard, write_shards

    d = spark.createDataFrame([(i, f"h{i % 5}", f"t{i}", i * 10, "own") for i in range(50)], "doc_id long, host string, text string, shard int, key string")
    out = with_shard(d, [1.0] * 7, ["host"])
    assert out.columns == ["doc_id", "host", "text", "key", "shard", "grown_shard"]
    rows = out.collect()
    assert all(r.key == "own" for r in rows) and len({(r.host, r.shard) for r in rows}) == 5
    write_shards(d, str(tmp_path / "out"), [1.0] * 7, ["host"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.shard) for r in back.collect()) == Counter((r.doc_id, r.shard) for r in rows)


def test_places_of_a_repeated_row_are_spread(spark, monkeypatch):
    from quillmesh.llm import mixing, sharding

    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    d = spark.range(1200).select(F.when(F.col("id") < 900, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    plans = []
    monkeypatch.setattr(sharding, "running_sums", lambda *a: plans.append(mixing.running_sums(*a)) or plans[-1])
    got = sharding.shard_digest(d).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 1200 and all(sorted(s) == list(range(len(s))) for s in by.values())


def lloyd(rows, parts=16, entries=64, scale=256, rounds=2):
    """Plain Lloyd over lists of whole numbers: code, error and codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == dims]
    width = -(-dims // parts)
    whole = [[math.floor(scale * x) for x in r[1]] + [0] * (parts * width - dims) for r in rows]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, entries):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(c[p], book[p])[0]].append(c[p])
            book[p] = [[sum(x) // len(members[e]) for x in zip(*members[e], strict=True)] if members[e] else book[p][e] for e in range(len(book[p]))]
    found = [[nearest(c[p], book[p]) for p in range(parts)] for c in cut]
    return Counter((r[0], "".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f), r[2]) for r, f in zip(rows, found, strict=True)), book


@pytest.mark.parametrize("parts,entries,dims,rounds,size", [(16, 64, 64, 2, 1.0), (3, 5, 8, 4, 1.0), (4, 1, 4, 2, 1.0), (2, 40, 6, 3, 90_000.0), (4, 6, 4, 5, 0.02)])
def test_vector_codes_are_plain_lloyd(spark, monkeypatch, parts, entries, dims, rounds, size):
    from quillmesh.llm import vector_codes as m

    monkeypatch.setattr(m, "BLOCK_VALUES", 1)  # blocks of 64 vectors
    rng = random.Random(dims * parts)
    rows = [(rng.randrange(150), [float(np.float32(rng.gauss(0, size))) for _ in range(dims)], rng.choice([None, 1, 2])) for _ in range(230)]
    rows += [rows[0]] * 30 + [(None, [0.5] * dims, 3), (None, [0.25] * dims, None)]
    bad = [(1, None, 1), (0, [], 1), (0, [float("nan")] * dims, 1), (2, [1.0] * (dims - 1) + [None], 1), (2, [float("inf")] * dims, 1), (2, [-float("inf")] * dims, 1), (900, [1.0] * (dims + 1), 1)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<float>, label int, ids string, error int").repartition(4)
    codes, book, tables = m.compress(d, parts, entries, 256, rounds)
    want, want_book = lloyd(rows, parts, entries, 256, rounds)
    assert Counter((r.vec_id, r.code, r.error, r.label) for r in codes.collect()) == want
    assert book.tolist() == want_book
    assert len(tables) == rounds


def test_few_parts_are_rescanned_once_codebooks_settle(spark):
    from quillmesh.llm import vector_codes as m

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.05, 8)).tolist(), 0) for i in range(1500)]
    _, _, tables = m.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 2, 12, 256, 6)
    popped = [t.agg(F.sum("popped")).first()[0] for t in tables]
    assert popped[0] == 3000 and popped[-1] < 100


def test_vector_digest_of_nothing_and_of_labels(spark):
    from quillmesh.llm.vector_codes import vector_codes_digest

    schema = "vec_id long, embedding array<double>, label string"
    assert vector_codes_digest(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes_digest(spark.createDataFrame([(1, [float("nan")], "a"), (2, None, None)], schema)).collect() == []
    got = {r.vec_id: r for r in vector_codes_digest(spark.createDataFrame([(i, [i / 7.0] * 16, [None, "null", "b"][i % 3]) for i in range(200)], schema)).collect()}
    for k in range(3):
        own = [r for i, r in got.items() if i % 3 == k]
        assert {r.label_error for r in own} == {sum(r.error for r in own)}


def edits(words):
    """Near words of each word, over all pairs."""

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    return {w: {x for x in words if near(w, x)} for w in words}


def some_words(seed, n, letters="abé", least=1, most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("most", [1, 3, 20, 1000])
@pytest.mark.parametrize("letters,least", [("abé", 1), ("ab", 7), ("abcdefghijÿ", 4)])
def test_near_words_are_all_pairs_once(spark, most, letters, least):
    from quillmesh.llm.spelling import near_words

    words = some_words(3, 160, letters, least) + ["q" * 40, "q" * 41, "q" * 39 + "z", "x" + "q" * 40]
    got = Counter((r.word, r.near) for r in near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), most).collect())
    assert got == Counter((w, x) for w, near in edits(words).items() for x in near)


def test_a_block_of_a_third_of_all_words(spark, monkeypatch):
    from quillmesh.llm import common
    from quillmesh.llm.spelling import near_words

    monkeypatch.setattr(common, "HEAVY", 20)
    words = sorted({"common" + w for w in some_words(8, 300, "abcdef", 4, 7)} | set(some_words(9, 300, "abcdefgh", 7, 12)))
    got = Counter((r.word, r.near) for r in near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), 16).collect())
    assert got == Counter((w, x) for w, near in edits(words).items() for x in near)


def test_forms_and_roots(spark):
    from quillmesh.llm.spelling import variants

    counts = {"abcdefg": 100_000, "abcdefgh": 10_000, "abcdefghi": 1_000, "abcdefghij": 100, "abcdefgx": 9_999, "zbcdefg": 10_001, "lonely": 5, "tiesaaa": 10, "tiesaab": 100, "tiesaac": 100}
    got = {r.word: r for r in variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    near = edits(list(counts))
    for w, r in got.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 10 * counts[w] else None
        assert (r.n, r.n_near, r.form, r.form_n) == (counts[w], len(near[w]), form, counts.get(form))
        while form:
            w, form = form, got[form].form
        assert r.root == w
    assert got["abcdefghij"].root == "abcdefg" and got["tiesaaa"].form == "tiesaab"


def test_spelling_of_awkward_texts(spark, monkeypatch):
    from quillmesh.llm import spelling as m

    monkeypatch.setattr(m, "HELD", 50)
    rows = corpus(6, 60) + [(i, "Colourful colourful cölourful COLOURFUL colorful étéÉté× " * (i % 3 + 1), None, None) for i in range(300, 380)] + [(None, "colourful nullish", "en", "a")] * 2
    want: Counter = Counter()
    for i, t, _, _ in rows:
        for run in m.re.findall(m.RUN, t or ""):
            word = m.spelled(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in run))
            if len(word) >= 7:
                want[word] += 1
    want = {w: n for w, n in want.items() if n >= 2}
    assert any(len(w) == 8 and "col" in w for w in want)
    got = m.spelling_digest(frame(spark, rows).repartition(3)).collect()
    assert {r.word: r.n for r in got} == want
    near = edits(list(want))
    assert {r.word: r.n_near for r in got} == {w: len(x) for w, x in near.items()}
    assert m.spelling_digest(frame(spark, [(1, None, None, None), (2, "", None, None)])).collect() == []
    groups = {r.root: r.n_words for r in m.variant_groups(spark.createDataFrame(got)).collect()} if any(r.form for r in got) else {}
    assert all(n > 1 for n in groups.values())
