"""Clashing names, heavy keys, empty inputs, bounded samples, and models against plain versions of themselves."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_document_operators import closest, corpus, frame, labelled

CLASH = ("left_text", "count", "gone", "drop", "lost", "__k", "__d", "__s", "t_id", "t_source", "n", "row", "share", "owner", "head", "win", "list", "size", "copies", "key")


def clashing(spark, rows):
    d = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASH})


def test_columns_of_any_name_stay(spark):
    from quillmesh.llm import decontaminate, language_id, line_dedup, mixing, simhash

    d = clashing(spark, corpus(2, 25))
    items = spark.createDataFrame([(1, " ".join(corpus(2, 25)[0][1].split()[:20]))], "item_id long, text string")
    for out in (line_dedup.dedup_lines(d), line_dedup.drop_shared_blocks(d), simhash.keep_first(d), decontaminate.drop_contaminated(d, items), language_id.keep_recognised(d, 0.0), mixing.mix(d)):
        replaced = {"size"} if "taken" in out.columns else set()
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in set(CLASH) - replaced)


def test_heavy_keys_change_nothing(spark, monkeypatch):
    """Every key heavy, every owner and range small: the same results as with none."""
    from quillmesh.llm import common, line_dedup, mixing, simhash

    rows = corpus(3, 30) + [(200 + i, "the same line of many words stands in each of these texts\nand one more\n" + str(i % 3), "en", "a") for i in range(40)]
    d = frame(spark, rows)
    ask = lambda: [Counter(map(tuple, q.collect())) for q in (line_dedup.line_dedup_digest(d), simhash.simhash_digest(d), mixing.mix_digest(d))]
    want = ask()
    for module, name, value in ((common, "HEAVY", 40), (line_dedup, "OWNER_SHARE", 3), (mixing, "RANGE_ROWS", 5)):
        monkeypatch.setattr(module, name, value)
    assert ask() == want


def test_stars_link_what_tiles_link(spark):
    from quillmesh.llm.components import components
    from quillmesh.llm.simhash import close_links

    rng = random.Random(13)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(3):
        at = rng.getrandbits(64)
        for _ in range(40):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                at ^= 1 << b
            prints.add(at)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = close_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4, 5, 6, crowded=3)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links.collect())
    root = {r.node: r.root for r in components(links).collect()}
    comp = closest([p & (1 << 64) - 1 for p in prints], list(range(len(prints))), 4)
    assert len({(root.get(p, p), c) for p, c in zip(prints, comp, strict=True)}) == len(set(comp)) == len({root.get(p, p) for p in prints})


def test_sample_is_the_least_of_all(spark):
    from quillmesh.llm.shape import sample_bound

    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id", F.lit(3))).limit(500).collect()]
    assert sorted(r.doc_id for r in sample_bound(ids, 500).collect()) == sorted(want)
    assert sample_bound(ids.limit(40), 500).count() == 40


def test_rows_without_id_are_not_held_out(spark):
    from quillmesh.llm import language_id, quality_gam, toxicity

    d, labels = labelled(spark, 60)
    for out in (language_id.language_digest(d), quality_gam.quality_scores(d, labels), toxicity.toxicity_scores(d, labels)):
        assert [r.held_out for r in out.collect() if r.doc_id is None] == [False]


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and "taken" in out.columns


def test_additive_scores_are_sums_of_table_entries():
    from quillmesh.llm.quality_gam import AdditiveModel

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = AdditiveModel(x, y)
    at = lambda cuts, v: sum(c <= v for c in cuts)
    for row, got in zip(x[:40], m.predict(x[:40]), strict=True):
        s = m.prior + sum(t[at(c, v)] for t, c, v in zip(m.tables, m.cuts, row, strict=True))
        s += sum(t[at(m.coarse[a], row[a]), at(m.coarse[b], row[b])] for (a, b), t in m.pairs.items())
        assert got == pytest.approx(1 / (1 + np.exp(-s)))
    assert np.mean((m.predict(x) > 0.5) == y) > 0.85 and m.pairs


def test_tree_scores_are_walks_and_rise_with_the_raw_score():
    from quillmesh.llm.toxicity import DEPTH, RATE, BoostedTrees

    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    m = BoostedTrees(x, y, np.arange(600) % 4 == 0)

    def walk(tree, row, depth=0):
        if isinstance(tree, float):
            return tree
        assert depth < DEPTH
        j, cut, low, high = tree
        return walk(low if sum(c <= row[j] for c in m.cuts[j]) <= cut else high, row, depth + 1)

    raw = [1 / (1 + np.exp(-(m.prior + RATE * sum(walk(t, row) for t in m.trees)))) for row in x[:50]]
    got = m.predict(x[:50])
    assert np.allclose(got, np.interp(raw, m.iso_x, m.iso_y))
    order = np.argsort(raw)
    assert (np.diff(got[order]) >= 0).all() and np.mean((m.predict(x) >= 0.3) == y) > 0.95


def test_bloom_filters_agree_with_exact_sets():
    from quillmesh.llm.language_id import BloomModel, grams_of

    rng = random.Random(5)
    words = [["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60)] for _ in range(5)]
    sets = [np.unique(grams_of(" ".join(w))) for w in words]
    m = BloomModel(list("abcde"), sets)
    for i in range(100):
        text = " ".join(rng.choice(words[i % 5] if rng.random() < 0.7 else rng.choice(words)) for _ in range(20))
        gram = grams_of(text)
        share = [np.isin(gram, s).mean() for s in sets]
        lang, score = m.predict(text)
        assert lang == "abcde"[int(np.argmax(share))] and abs(score - max(share)) < 0.02


def test_substring_dedup_of_rows_repeated_very_often(spark):
    """Equal rows take about the time of distinct ones: their windows are gathered once, not once a copy."""
    import time

    from quillmesh.llm.substring_dedup import brute_force, substring_dedup_digest

    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    same, others = words(120), [words(90) for _ in range(30)]
    others += [others[0], f"{others[1]} {words(20)}", same + " " + words(40), None, ""]
    few = spark.createDataFrame([(i, t) for i, t in enumerate(others)], "doc_id long, text string")
    took = {}
    for name, ids in (("distinct", F.col("id") + 1000), ("equal", F.lit(1000))):
        text = F.lit(same) if name == "equal" else F.concat(F.lit(same), F.lit(" "), F.col("id").cast("string"))
        d = few.union(spark.range(20_000).select(ids.cast("long"), text)).repartition(4)
        start = time.perf_counter()
        got = Counter(map(tuple, substring_dedup_digest(d).collect()))
        took[name] = time.perf_counter() - start
    want = Counter((i, *w) for i, w in enumerate(brute_force([*others, same, same])[:-2]))
    want[(1000, *brute_force([same, same])[0])] = 20_000
    assert got == want
    assert took["equal"] < 3 * took["distinct"] + 10
