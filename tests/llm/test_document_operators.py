"""The document operators against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from importlib import import_module

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, words int, __other int, size int"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 1, 2, 3) for i, t, lang, src in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, texts = [], []
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 25))) for _ in range(rng.randint(1, 9)))
        if texts and rng.random() < 0.35:
            old = rng.choice(texts).split("\n")
            text = "\n".join(old[: max(1, len(old) // 2)]) + "\n" + text if rng.random() < 0.5 else "\n".join(old)
        texts.append(text)
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])))
    same = "Z " + texts[0]
    rows += [(100, None, "en", "a"), (101, "", None, None), (102, " \t\n\x0b\x0c\r ", "en", "b"), (103, same, "en", "a"), (103, same, "en", "a"), (None, same, "en", "a"), (None, None, None, None), (104, "É" * 50 + " mit license APACHE\tlicense general-public/license x", "en", "a"), (105, " ".join(["ab cd ef"] * 400), "fr", "b"), (106, "line one is here\n" * 30, "fr", "b"), (107, "x" * 100_000, "en", "b"), (103, "other text of the same id", "en", "a")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3).cache()


def test_substring_dedup_is_brute_force(spark, docs):
    from quillmesh.llm.substring_dedup import brute_force, substring_dedup_digest

    rows = docs.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute_force([r.text for r in rows]), strict=True))
    assert Counter(tuple(r) for r in substring_dedup_digest(docs).collect()) == want
    assert sum(k[2] * v for k, v in want.items()) > 100


@pytest.mark.parametrize("window,bits", [(1, 1 << 16), (2, 1 << 10), (7, 1 << 10), (35, 1 << 10)])
def test_substring_dedup_with_a_crowded_sketch(spark, window, bits):
    from quillmesh.llm import substring_dedup as m

    rows = [(i, t, None, None) for i, (_, t, _, _) in enumerate(corpus(5, 30))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in m.remove_repeats(frame(spark, rows), window, bits).collect()}
    want = m.brute_force([r[1] for r in rows], window)
    assert got == {i: w[:2] for i, w in enumerate(want)}


@pytest.mark.parametrize("group_bytes", [8, 800])
def test_substring_dedup_of_a_passage_between_other_neighbours(spark, group_bytes):
    """One anchor for many distinct windows: their group is dealt again, without losing a repeat."""
    from quillmesh.llm import substring_dedup as m

    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    footer, whole = words(30), words(45)
    texts = [f"{words(40)} {footer} {words(40)}" + (f" {whole} {words(5)}" if i % 7 == 0 else "") for i in range(120)]
    texts += [texts[3], texts[3], "", None]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in m.remove_repeats(docs, group_bytes=group_bytes).collect()}
    want = {i: w[:2] for i, w in enumerate(m.brute_force(texts))}
    assert got == want
    assert sum(n for _, n in want.values()) > 18 * 45


def fingerprint(text):
    import xxhash

    w = SPACED.findall(ascii_lower(text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closest(prints, ids, distance):
    """component id of each row, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)].append(d)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def test_simhash_is_brute_force(docs):
    from quillmesh.llm.simhash import simhash_digest

    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    comp = closest(prints, [r.doc_id for r in rows], 4)
    want = Counter((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, comp, strict=True))
    assert Counter(tuple(r) for r in simhash_digest(docs).collect()) == want


def test_one_row_of_each_simhash_group_stays(spark):
    """Also where unlike texts lack an id or share one."""
    from quillmesh.llm.simhash import keep_first

    rng = random.Random(9)
    a, b, c, d, e = (" ".join(str(rng.random()) for _ in range(40)) for _ in range(5))
    kept = keep_first(frame(spark, [(None, a, "en", "s"), (None, b, "en", "s"), (None, c, "en", "s"), (None, a, "en", "s"), (7, d, "en", "s"), (7, e, "en", "s"), (3, c, "en", "s"), (8, e, "en", "s")])).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, a), (None, b), (3, c), (7, d), (7, e)])


@pytest.mark.parametrize("tile,blocks", [(5, 6), (40, 7), (1500, 8)])
def test_simhash_links_in_crowded_files(spark, tile, blocks):
    """Chains of near fingerprints, many in one file, dealt into small tiles."""
    from quillmesh.llm.components import components
    from quillmesh.llm.simhash import close_links

    rng = random.Random(3)
    prints = set()
    for _ in range(4):
        at = rng.getrandbits(64)
        for _ in range(60):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                at ^= 1 << b
            prints.add(at)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = close_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4, tile, blocks)
    root = {r.node: r.root for r in components(links).collect()}
    ids = list(range(len(prints)))
    comp = closest([p & (1 << 64) - 1 for p in prints], ids, 4)
    groups = defaultdict(set)
    for p, c in zip(prints, comp, strict=True):
        groups[c].add(root.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def contamination(text, items):
    w = ALNUM.findall(ascii_lower(text or ""))
    hit, found = set(), set()
    for i, item in items:
        iw = ALNUM.findall(ascii_lower(item or ""))
        n = min(13, len(iw))
        for win in {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if iw else ():
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) == win:
                    hit |= set(range(s, s + n))
                    if i is not None:
                        found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_is_brute_force(spark, docs):
    from quillmesh.llm.decontaminate import decontamination_digest

    rows = docs.collect()
    long = " ".join(next(r.text for r in rows if r.doc_id == 0).split()[:40])
    items = [(1, long.upper()), (2, "mit license"), (10, " ".join(long.split()[3:30])), (11, None), (12, "..."), (13, "abcdef"), (None, " ".join(long.split()[:14])), (2, "apache license general"), (14, "x" * 100_000), (15, "license")]
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, words string")
    want = Counter((r.doc_id, *contamination(r.text, items)) for r in rows)
    assert Counter(tuple(r) for r in decontamination_digest(docs, benchmark).collect()) == want
    assert sum(v for k, v in want.items() if k[2]) > 3


def test_license_base_is_brute_force(docs):
    from quillmesh.llm.licenses import TEMPLATES, license_digest, license_scan

    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = Counter()
    for r in docs.collect():
        w = ALNUM.findall(ascii_lower(r.text or ""))
        at = [(s, label) for p, label in phrases.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        want[r.doc_id, len(w), len(at), min((a[0] for a in at), default=None), max((a[0] for a in at), default=None), ",".join(sorted({a[1] for a in at}))] += 1
    got = license_digest(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",") + [""]) for r in got)
    spark = docs.sparkSession
    rows = [(i, f"intro words {t.replace('the', 'thee', 1)} and more", None, None) for i, t in enumerate(x for ts in TEMPLATES.values() for x in ts)]
    labels = [label for label, ts in TEMPLATES.items() for _ in ts]
    found = {r.doc_id: r.labels.split(",") for r in license_scan(frame(spark, rows)).collect()}
    assert all(labels[i] in found[i] for i in found)


def test_license_labels_of_altered_notices(spark):
    """Each template with a word left out, one put in, one exchanged, or cut in two lines: found, and not as its neighbour; other text has no label."""
    from quillmesh.llm.licenses import TEMPLATES, license_scan

    rng = random.Random(20)
    rows, want = [], []
    for label, texts in TEMPLATES.items():
        for t in texts:
            words = t.split()
            for change in range(4):
                at = rng.randrange(4, len(words) - 3) if len(words) > 8 else None
                w = list(words)
                if at is not None and change < 3:
                    w[at : at + 1] = ([], [w[at], "indeed"], ["other"])[change]
                rows.append((len(rows), "see here: " + " ".join(w[:6]) + "\n# " + " ".join(w[6:]) + " end", None, None))
                want.append((label, change == 3 or at is None))
    rows.append((10_000, "permission to use a copy of this text is not granted, any license of the software and the terms are free of use", None, None))
    found = {r.doc_id: set(r.labels.split(",")) for r in license_scan(frame(spark, rows)).collect()}
    assert found[10_000] == {""}
    assert all(label in found[i] for i, (label, plain) in enumerate(want) if plain)
    assert np.mean([label in found[i] for i, (label, _) in enumerate(want)]) > 0.9
    assert [(label, found[i], rows[i][1]) for i, (label, plain) in enumerate(want) if plain and label.startswith(("cc", "lgpl", "agpl")) and found[i] - {"gpl"} != {label}] == []


def test_quality_base_is_brute_force(docs):
    from quillmesh.llm.quality_rules import quality_rules_digest

    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = SPACED.findall(t)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        rep = len({j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)})
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)] += 1
    got = quality_rules_digest(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_outliers(spark):
    from quillmesh.llm.quality_rules import quality_rules_digest

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word().capitalize() if k % 12 == 0 else word() for k in range(200)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "$$$" for _ in range(200)), "en", "s") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules_digest(frame(spark, rows)).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(20))


def test_quality_outliers_of_each_statistic(spark):
    """Texts that differ from their group in one statistic alone are rejected, whichever it is."""
    from quillmesh.llm.quality_rules import quality_rules_digest

    rng = random.Random(12)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))).capitalize() if k % 12 == 0 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    words = lambda n=200: [word(k) for k in range(n)]
    rows = [(i, " ".join(words()), "en", "s") for i in range(300)]
    lines = ["Abcde fghab", "cdefg habcd", "efgha bcdef", "ghabc defgh", "aabbc ddeef", "gghha abbcc"]
    for i in range(5):
        part = words(28)
        rows += [(1000 + i, " ".join(w + "abcdefgh" for w in words()), "en", "s"), (1010 + i, " ".join(w + "$" for w in words()), "en", "s")]
        rows += [(1020 + i, "\n".join(rng.choice(lines) for _ in range(100)), "en", "s"), (1030 + i, " ".join(words()).upper(), "en", "s"), (1040 + i, " ".join(part + words(144) + part), "en", "s")]
    got = {r.doc_id: r for r in quality_rules_digest(frame(spark, rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {1000 + 10 * k + i for k in range(5) for i in range(5)}


def test_mix_is_brute_force(spark, docs):
    from quillmesh.llm.mixing import mix, mix_digest

    got = mix_digest(docs).collect()
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(SPACED.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, total = {}, set(), sum(size.values())
    while True:
        rest = total - sum(3 * size[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 3 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert Counter(map(tuple, got)) == Counter(tuple(r) for r in mix_digest(docs.repartition(7)).collect())
    whole = mix(docs)
    assert whole.count() == len(got) and whole.agg(F.sum("taken")).first()[0] == sum(taken.values())


def test_mix_ranges(spark, monkeypatch):
    from quillmesh.llm import mixing

    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    rows = [(i, "w " * (i % 40), "abcde"[min(4, i % 9)], None) for i in range(400)]
    d = frame(spark, [(i, t, "en", s) for i, t, s, _ in rows])
    narrow = {(r.doc_id, r.taken) for r in mixing.mix_digest(d).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10_000)
    assert narrow == {(r.doc_id, r.taken) for r in mixing.mix_digest(d).collect()}


def test_patience_and_line_dedup(spark):
    from quillmesh.llm.line_dedup import dedup_lines, drop_shared_blocks, patience

    assert patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert patience([5, 1, 5, 2], [1, 5, 2, 5]) in ([(1, 0), (2, 1), (3, 2)],)
    line = lambda i: f"this is the long line number {i} of them all, indeed"
    one, two = [line(i) for i in range(6)], [line(9), line(1), "short", line(2), line(10)]
    rows = [(1, "\n".join(one), "en", "a"), (2, "\n".join(two), "en", "a"), (3, "\n".join(one), "en", "a"), (4, None, None, None), (5, "", None, None), (None, "\n".join(two), "en", "a"), (6, line(20), "en", "b"), (6, line(20), "en", "b")]
    d = frame(spark, rows)
    got = Counter((r.doc_id, r.text, r.n_removed) for r in dedup_lines(d).collect())
    left = "\n".join([line(9), "short", line(10)])
    assert got == Counter({(1, "\n".join(one), 0): 1, (2, left, 2): 1, (3, "", 6): 1, (4, None, 0): 1, (5, "", 0): 1, (None, "", 5): 1, (6, line(20), 0): 2})
    kept = drop_shared_blocks(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in (1, 2, 4, 5, 6, 6)]


def shared_lines(texts, block_words=10):
    """The lines of each text that stand in a block of block_words words or more of an earlier one, by comparing all pairs."""
    lines = [[x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for t in texts]
    out = []
    for at, own in enumerate(lines):
        drop = set()
        for old in lines[:at]:
            for i in range(len(own)):
                for j in range(len(old)):
                    n = 0
                    while i + n < len(own) and j + n < len(old) and own[i + n] == old[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in own[i : i + n]) >= block_words:
                        drop |= set(range(i, i + n))
        out.append(drop)
    return out


def test_line_dedup_is_brute_force(spark):
    """Blocks whose lines have other first owners, blocks of short lines, common, moved and repeated ones, and blank lines."""
    from quillmesh.llm.line_dedup import dedup_lines

    five = lambda i: f"five words {i} of {i}"
    verse = [f"rose {i}" for i in range(6)]
    texts = [five(1), five(2), f"{five(1)}\n{five(2)}\nb", f"c\n{five(1)}\n{five(2)}", "\n".join(verse), "\n".join(["d", *verse]), "\n".join([five(7)] * 2 + ["x"]), "\n".join(["y"] + [five(7)] * 3)]
    texts += ["\n".join([*(five(i) for i in (11, 12)), "z", *(five(i) for i in (13, 14))]), "\n".join([*(five(i) for i in (13, 14)), "w", *(five(i) for i in (11, 12))])]
    texts += [f"e {i}\nthis line of ten words stands in all of them\nf {i}" for i in range(150)]
    rng = random.Random(8)
    pool = ["", "", " one", "two words", five(21), five(22), "a line of seven words in all ", "this line has ten words or even a few more"]
    texts += ["\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {rng.random()} x" for _ in range(rng.randint(1, 14))) for _ in range(60)]
    want = {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop), len(drop)) for i, (t, drop) in enumerate(zip(texts, shared_lines(texts), strict=True))}
    assert [want[i][1] for i in (3, 5, 7, 9)] == [2, 6, 3, 4]
    assert {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()} == want


def aligned_lines(texts, block_words=10):
    """The lines of each text that leave it by alignment alone: plain recursion over every pair that a line's rarest run leads to."""
    lines = [[x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for t in texts]

    def runs(own):
        """run -> where it begins and ends, counted from every line forwards and backwards."""
        spans = defaultdict(set)
        for i in range(len(own)):
            for step in (1, -1):
                k, n = i, 0
                while 0 <= k < len(own):
                    n += len(own[k].split())
                    if n >= block_words:
                        lo, hi = min(i, k), max(i, k) + 1
                        spans[tuple(own[lo:hi])].add((lo, hi))
                        break
                    k += step
        return spans

    def match(a, b, i, i2, j, j2):
        head = []
        while i < i2 and j < j2 and a[i] == b[j]:
            head.append((i, j))
            i, j = i + 1, j + 1
        tail = []
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            tail.append((i2, j2))
        if i == i2 or j == j2:
            return head + tail[::-1]
        once = [(a.index(x, i, i2), b.index(x, j, j2)) for x in dict.fromkeys(a[i:i2]) if a[i:i2].count(x) == 1 and b[j:j2].count(x) == 1]
        nth = [(p, q) for p in range(i, i2) for q in range(j, j2) if a[p] == b[q] and a[i:p].count(a[p]) == b[j:q].count(b[q])]
        pairs, best = sorted(once or nth), {}
        for k, (_, q) in enumerate(pairs):  # the longest rising run, of those equally long the one that patience sorting ends with
            longest = max([0] + [best[h] for h in range(k) if pairs[h][1] < q])
            best[k] = longest + 1
        chain, at, most = [], None, max(best.values(), default=0)
        for size in range(most, 0, -1):
            fit = [k for k in best if best[k] == size and (at is None or (k < at and pairs[k][1] < pairs[at][1]))]
            at = max(fit)
            chain.append(pairs[at])
        chain = chain[::-1]
        out = head + tail
        for (p, q), (p2, q2) in zip([(i - 1, j - 1), *chain], [*chain, (i2, j2)], strict=True):
            out += ([(p, q)] if p >= i else []) + (match(a, b, p + 1, p2, q + 1, q2) if chain else [])
        return sorted(out)

    all_runs = [runs(x) for x in lines]
    docs_of = Counter(r for x in all_runs for r in x)
    owner = {}
    for at, x in enumerate(all_runs):
        for r in x:
            owner.setdefault(r, at)
    out = []
    for at, own in enumerate(lines):
        drop, ways = set(), set()
        for k in range(len(own)):
            led = [r for r, spans in all_runs[at].items() if docs_of[r] > 1 and owner[r] < at and any(lo <= k < hi for lo, hi in spans)]
            rare = [r for r in led if docs_of[r] == min(docs_of[x] for x in led)]
            ways.add(frozenset(owner[r] for r in rare))
        unsure = any(len(w) > 1 for w in ways)
        for old in {o for w in ways for o in w}:
            block = []
            for p, q in [*match(own, lines[old], 0, len(own), 0, len(lines[old])), (-9, -9)]:
                if block and (p, q) != (block[-1][0] + 1, block[-1][1] + 1):
                    if sum(len(own[k].split()) for k, _ in block) >= block_words:
                        drop |= {k for k, _ in block}
                    block = []
                block.append((p, q))
        out.append((drop, unsure))
    return out


def test_alignment_decides_what_leaves(spark, monkeypatch):
    """By alignment alone: brute force; a moved block stays; without the alignment nothing leaves."""
    from quillmesh.llm import line_dedup as m

    ten = lambda i: f"line {i} of ten words or more stands right here, {i}"
    texts = ["\n".join([ten(1), ten(2), ten(3)]), "\n".join([ten(3), ten(1), ten(2)]), "\n".join([ten(7), ten(7), ten(8)]), "\n".join(["x", ten(7), ten(7)])]
    rng = random.Random(18)
    pool = ["", " one", "two words", *(f"five words {i} of {i}" for i in range(4)), "a line of seven words in all ", *(ten(i) for i in range(20, 24))]
    texts += ["\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {rng.random()} x" for _ in range(rng.randint(1, 14))) for _ in range(60)]
    d = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.text, r.n_removed) for r in m.dedup_lines(d, moved=False).collect()}
    sure = 0
    for i, (t, (drop, unsure)) in enumerate(zip(texts, aligned_lines(texts), strict=True)):
        if not unsure:  # of runs equally rare the hash decides
            assert got[i] == ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop), len(drop))
            sure += bool(drop)
    assert sure > 10
    assert [got[i][1] for i in range(4)] == [0, 2, 0, 2] and got[1][0] == ten(3)
    assert {r.doc_id: r.n_removed for r in m.dedup_lines(d).collect()}[1] == 3
    monkeypatch.setattr(m, "patience", lambda a, b: [])
    out = m.common_blocks([1, 2, 3], [10, 10, 10], [1, 2, 3], 10)
    assert out == []


def test_lines_are_led_by_their_rarest_run():
    from quillmesh.llm.line_dedup import rarest

    first, last, n, run = (np.array(x) for x in ([0, 1, 2, 4], [2, 3, 3, 5], [5, 2, 9, 3], [1, 2, 3, 4]))
    assert rarest(first, last, n, run).tolist() == [0, 1, 3]


def test_language_id(spark):
    from quillmesh.llm.language_id import keep_recognised, language_digest

    rng = random.Random(4)
    voc = {"en": ["the", "house", "window", "there", "with", "which"], "fr": ["le", "maison", "fenêtre", "où", "avec", "lequel"], "de": ["das", "häuser", "fenster", "dort", "mit", "welches"]}
    rows = [(i, " ".join(rng.choice(voc[lang]) for _ in range(30)), lang, "s") for i, lang in enumerate(list(voc) * 40)]
    rows += [(500, None, "en", "s"), (501, "12 ?? 34", "fr", "s"), (502, "", None, None), (None, "fenêtre maison", None, None)]
    d = frame(spark, rows)
    got = language_digest(d).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
            assert r.lang_pred == ("und" if r.doc_id >= 500 else rows[r.doc_id][2])
    assert {r.doc_id for r in keep_recognised(d).collect()} == {r[0] for r in rows} - {500, 501, 502}


def test_language_id_learns_every_language(spark):
    """More languages than a word of the filter has bits."""
    from quillmesh.llm.language_id import language_digest

    rng = random.Random(14)
    voc = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for _ in range(70)]
    rows = [(i, " ".join(rng.choice(voc[i % 70]) for _ in range(25)), f"l{i % 70:02}", "s") for i in range(700)]
    assert {r.doc_id: r.lang_pred for r in language_digest(frame(spark, rows)).collect()} == {i: lang for i, _, lang, _ in rows}


def labelled(spark, n=300):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "you"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["XX!!", "$$$", "||", "AB##"]) for _ in range(60))
    toxic = lambda: good() + " you total grobnik and moron " + good()
    rows, labels = [], []
    for i in range(n):
        kind = i % 3
        rows.append((i, (good, bad, toxic)[kind](), "en", "s"))
        labels.append((i, int(kind != 1), int(kind == 2), "x"))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (None, good(), "en", "s")]
    return frame(spark, rows), spark.createDataFrame(labels + [(0, None, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("module,function,label,mod,out", [("quality_gam", "quality_scores", "quality", 5, 0), ("toxicity", "toxicity_scores", "toxic", 4, 2)])
def test_classifiers(spark, module, function, label, mod, out):
    d, labels = labelled(spark)
    got = getattr(import_module(f"quillmesh.llm.{module}"), function)(d, labels).collect()
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None and r.doc_id is not None}
    assert len(got) == d.count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == out) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_empty_tables(spark):
    """Every operator gives an empty result, with its columns, for an empty table."""
    from quillmesh.llm.queries import _QUERIES

    d = frame(spark, []).limit(0)
    more = {"documents": d, "benchmark": spark.createDataFrame([], "item_id long, text string"), "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "embeddings": spark.createDataFrame([], "vec_id long, embedding array<float>, label int")}
    for module, function, tables in _QUERIES.values():
        assert getattr(import_module(f"quillmesh.llm.{module}"), function)(*[more[t] for t in tables]).collect() == []
    from quillmesh.llm import decontaminate, quality_gam

    one = frame(spark, [(1, "some words", "en", "s")])
    assert [tuple(r)[:4] for r in decontaminate.decontamination_digest(one, more["benchmark"]).collect()] == [(1, 2, 0, 0)]
    assert quality_gam.quality_scores(one, more["labels"]).count() == 1


def test_every_operator_on_awkward_rows(spark, docs):
    """One row out for each row in, whatever the rows."""
    from quillmesh.llm.queries import _QUERIES

    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "mit license")], "item_id long, text string")
    ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
    for module, function, tables in _QUERIES.values():
        if module in ("vector_codes", "spelling"):  # rows of vectors and of words
            continue
        out = getattr(import_module(f"quillmesh.llm.{module}"), function)(*[{"documents": docs, "labels": labels, "benchmark": benchmark}[t] for t in tables])
        assert Counter(r.doc_id for r in out.select("doc_id").collect()) == ids, module


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(str(i) for i in range(30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, at, str(tmp_path))
        assert nxt.columns == docs.columns and nxt.count() <= at.count()
        at = nxt
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.taken > 0 for r in out)
    texts = [r.text for r in out]
    assert len(set(texts)) == len(texts)
