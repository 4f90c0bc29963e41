"""Merging by the first key that is known equals the loop over an index, on chains, cycles, hot keys and random rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import merging

KEYS = "a string, b string, c string"


def loop(rows):
    index, root = {}, {}
    for i, *keys in sorted(rows):
        named = [(n, k) for n, k in enumerate(keys) if k is not None]
        root[i] = next((index[k] for k in named if k in index), i)
        for k in named:
            index[k] = root[i]
    return root


def run(spark, rows):
    df = spark.createDataFrame(rows, f"id bigint, {KEYS}").repartition(5)
    found = merging.merge_groups(df, "id", ["id"], [F.col(k) for k in "abc"]).collect()
    assert len(found) == len(rows)
    return {r.id: r.root for r in found}


def random_rows(n, width, seed):
    rng = random.Random(seed)
    return [(i, *[rng.choice([None, str(rng.randrange(width))]) for _ in "abc"]) for i in range(n)]


@pytest.mark.parametrize("rows", [
    [(i, str(i // 2), str((i + 1) // 2), None) for i in range(300)],  # a chain
    [(0, "x", "1", None), (1, "y", "2", None), (2, "z", "1", None), (3, "z", "2", None), (4, None, "2", None), (5, "y", "1", None), (6, None, "1", "c"), (7, None, None, "c")],  # keys that change hands
    [(i, "hot" if i % 3 else None, str(i % 7) if i % 2 else None, None) for i in range(400)],
    random_rows(400, 60, 1), random_rows(400, 300, 2),
    [(1, None, None, None), (2, None, None, None)], [],
])
def test_equal_to_the_loop(spark, rows):
    assert run(spark, rows) == loop(rows)


def test_records_take_the_first_filled_value(spark):
    rows = [(1, "k", None, None, None, ["x", "y"]), (2, None, "u", None, "late", ["z"]), (3, "k", "u", None, "first", ["y", "w", "w"]), (4, None, "u", None, "other", None)]
    df = spark.createDataFrame(rows, f"id bigint, {KEYS}, title string, tags array<string>")
    got = merging.merged_records(df, "id", ["id"], [F.col(k) for k in "abc"], ["a", "b", "title"], ["tags"]).collect()
    assert {(r.id, r.a, r.b, r.title, tuple(r.tags), r.n_rows) for r in got} == {(1, "k", "u", "first", ("x", "y", "w"), 3), (2, None, "u", "late", ("z",), 1)}
