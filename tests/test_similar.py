"""The join of like names equals a comparison of all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher, get_close_matches

import pytest

from quillmesh.operators import bibliography as b
from quillmesh.operators.similar import closest_names, similar_names


def names(rng, n, letters, known=()):
    out = [*known, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 24))) for _ in range(n))]
    for _ in range(n):
        w = list(rng.choice(out))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 1)
        out.append("".join(w))
    return out


@pytest.mark.parametrize("letters,least", [("ab", 0.9), ("abcdefgé", 0.9), ("abc", 0.75), ("abcdefg", 1.0)])
def test_all_pairs(spark, letters, least):
    rng = random.Random(len(letters))
    known = [(i % 3, w) for i, w in enumerate(names(rng, 90, letters))]
    asked = [(i % 3, w) for i, w in enumerate(names(rng, 60, letters, [w for _, w in known]))]
    known += known[:5] + [(0, "")]
    pairs = similar_names(spark.createDataFrame(asked, "paper long, asked string"), spark.createDataFrame(known, "paper long, known string"), ["paper"], least)
    got = [(r.paper, r.asked, r.known, r.ratio) for r in pairs.collect()]
    want = {(p, a, k, SequenceMatcher(None, k, a).ratio()) for p, a in asked for q, k in known if p == q and a and k}
    want = {x for x in want if x[3] >= least}
    assert len(got) == len(want) and set(got) == want and len(want) > 20


def test_third_rung_is_get_close_matches(spark):
    rng = random.Random(5)
    pool = names(rng, 60, "abcdeo")
    refs = [(i, i % 4, w, f"199{i % 2}{'a' if i % 5 == 0 else ''}") for i, w in enumerate(pool)]
    cites = [(f"c{i}", i % 4, w, f"199{i % 2}") for i, w in enumerate(names(rng, 80, "abcdeo", pool))]
    close = {(r.base, r.asked): r for r in closest_names(spark.createDataFrame([(1, "smithson")], "base long, asked string"), spark.createDataFrame([(1, w) for w in ("smithsen", "smithsonx", "smithsom", "smithson", "xmithson")], "base long, known string"), ["base"], 3, 0.8).collect()}
    assert close
    got = {r.citation: r for r in b.alike_references(spark.createDataFrame(cites, "citation string, paper long, surname string, year string"), spark.createDataFrame(refs, "ref long, paper long, surname string, year string")).collect()}
    n = 0
    for c, paper, surname, year in cites:
        known = sorted({w for _, p, w, y in refs if p == paper and y[:4] == year})
        close = [] if surname in known or len(surname) < 5 else get_close_matches(surname, known, n=3, cutoff=0.9)
        ids = {i for i, p, w, y in refs if p == paper and y[:4] == year and w in close}
        assert (c in got) == bool(close)
        if close:
            n += 1
            assert (got[c].surnames, got[c].n_refs, got[c].first_ref) == (",".join(close), len(ids), min(ids))
    assert n > 5


def test_long_names_do_not_multiply(spark):
    """Two names of some thousand letters meet through their segments; no neighbourhoods are written out."""
    long = "ab" * 1500
    found = similar_names(spark.createDataFrame([(1, long + "x")], "p long, asked string"), spark.createDataFrame([(1, long)], "p long, known string"), ["p"], 0.999)
    assert [(r.asked, r.known) for r in found.collect()] == [(long + "x", long)]
