"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities, second-person proximity, capitals, punctuation and obfuscation rates. One lexicon is fixed,
two are learned from training rows: words and word beginnings that toxic rows have far more often. Training rows are cut
in two folds and get their learned densities from the other fold's lexicon, so that the trees see what new texts show.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import WordHashes, materialize, rows_of
from quillmesh.llm.shape import binned, cut_points, sample_bound, shape, sigmoid

TRAIN_ROWS = 12_000
LEXICON_WORDS = 3_000
STEM = 5
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
NEAR = 6

# Insults, and pronouns of the second person in English, French, German and Spanish.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown fool imbecile jerk creep filth vermin garbage freak bastard".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton vous votre du dich dir dein ihr euch usted ustedes vosotros tú ti".split())
LOOKALIKES = str.maketrans("013457@$!|", "oleastasil")

WORD = re.compile(r"[^\W_]+")
MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[*#@$!|0-9]++[^\W\d_]++|(?:\b[^\W\d_][.\-*_ ]){3,}[^\W\d_]\b")
#: What every match of MASKED contains: a sign after a letter, or two single letters between separators. Quicker to look for.
MAY_MASK = (re.compile(r"[*#@$!|0-9](?<=[^\W\d_].)"), re.compile(r"[.\-*_ ][^\W\d_][.\-*_ ][^\W\d_][.\-*_ ]"))
NAMES = 8


def word_counts(batches):
    """(word, toxic, clean): in how many texts of the batch each word and each beginning, marked ^, stands, by label and fold."""
    for batch in batches:
        found: dict[tuple[int, str], list[int]] = {}
        for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "fold")), strict=True):
            words = set(WORD.findall((text or "").lower()))
            for w in words | {"^" + w[:STEM] for w in words if len(w) >= STEM}:
                found.setdefault((fold, w), [0, 0])[1 - y] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.int64())], ["fold", "word", "toxic", "clean"])


def lexicon(counts: DataFrame, totals: dict[int, tuple[int, int]], folds: tuple[int, ...]) -> frozenset:
    """The LEXICON_WORDS words and beginnings with the largest evidence for toxic texts in the given folds."""
    toxic, clean = (sum(totals.get(f, (0, 0))[i] for f in folds) for i in (0, 1))
    least = max(3, math.ceil(0.004 * toxic))
    rate = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    both = counts.filter(F.col("fold").isin(*folds)).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    top = both.filter(F.col("t") >= least).withColumn("rate", rate).filter("rate >= 6").orderBy(F.desc(F.col("t") * F.log("rate")), "word").limit(LEXICON_WORDS)
    return frozenset(r["word"] for r in top.select("word").collect())


class WordFlags(dict):
    """word -> its marks: 1 insult, 2 learned word, 4 learned beginning, or 8 second person alone; remembered for up to `most` words."""

    def __init__(self, learned: frozenset, most: int = 400_000):
        super().__init__()
        self.learned, self.most = learned, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        flags = 8 if word in SECOND_PERSON else (word in INSULTS) + 2 * (word in self.learned) + 4 * ("^" + word[:STEM] in self.learned)
        self[word] = flags
        return flags


def dense(text: str | None, flags: WordFlags, memo: WordHashes) -> list[float]:
    """Toxicity features of a whole text, then its shape features; zero for a text without words."""
    raw = text or ""
    words = WORD.findall(raw.lower())
    n = max(1, len(words))
    marks = np.fromiter(map(flags.__getitem__, words), np.uint8, len(words))
    fixed, known, stems = (int(np.count_nonzero(marks & bit)) for bit in (1, 2, 4))
    last_person, near = -NEAR - 1, 0
    wait: list[int] = []
    hits = np.flatnonzero(marks & 11)  # a beginning alone is not near anyone
    for i, second in zip(hits.tolist(), (marks[hits] & 8).tolist(), strict=True):
        if second:
            last_person = i
            near += sum(i - j <= NEAR for j in wait)
            wait = []
        elif i - last_person <= NEAR:
            near += 1
        else:
            wait.append(i)
    masked = MASKED.findall(raw) if any(p.search(raw) for p in MAY_MASK) else []
    hidden = sum(m.lower().translate(LOOKALIKES) in INSULTS for m in masked)
    scale = math.sqrt(n)
    return [fixed / scale, known / scale, stems / scale, near / scale, min(known, 20), min(stems, 20), len(masked) / n, float(hidden), *shape(raw.encode(), memo)]


class BoostedTrees:
    """Depth-limited regression trees on binned features, fitted to the logistic loss, and an isotonic map of their score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray):
        self.cuts = cut_points(x, BINS)
        self.trees: list[list] = []
        fit = ~check
        self.prior = float(np.log((y[fit].sum() + 0.5) / (fit.sum() - y[fit].sum() + 0.5)))
        self.iso_x, self.iso_y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        if fit.sum() < 20 or y[fit].min() == y[fit].max():
            return
        b = binned(x, self.cuts)
        bf, yf = b[fit], y[fit]
        score = np.full(len(yf), self.prior)
        for _ in range(TREES):
            p = sigmoid(score)
            tree = self._grow(bf, yf - p, p * (1 - p), np.arange(len(yf)), DEPTH)
            self.trees.append(tree)
            score += RATE * self._apply(tree, bf)
        if check.sum() >= 20 and y[check].max() == 1:
            self._calibrate(self._raw(b[check]), y[check])

    def _grow(self, b, g, h, rows, depth):
        if depth and len(rows) >= 20:
            best = (1e-6, None, None)
            total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for j, cuts in enumerate(self.cuts):
                gl = np.cumsum(np.bincount(b[rows, j], g[rows], len(cuts) + 1))[:-1]
                hl = np.cumsum(np.bincount(b[rows, j], h[rows], len(cuts) + 1))[:-1]
                if not len(gl):
                    continue
                gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                gain = np.where((hl > 0.5) & (hr > 0.5), gl**2 / (hl + 1) + gr**2 / (hr + 1) - total, 0)
                if gain.max() > best[0]:
                    best = (gain.max(), j, int(np.argmax(gain)))
            if best[1] is not None:
                left = b[rows, best[1]] <= best[2]
                return [best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)]
        return float(g[rows].sum() / (h[rows].sum() + 1)) if len(rows) else 0.0

    def _apply(self, tree, b):
        if isinstance(tree, float):
            return np.full(len(b), tree)
        j, cut, low, high = tree
        return np.where(b[:, j] <= cut, self._apply(low, b), self._apply(high, b))

    def _raw(self, b):
        return sigmoid(self.prior + RATE * sum((self._apply(t, b) for t in self.trees), np.zeros(len(b))))

    def _calibrate(self, s, y):
        """Pool adjacent violators; the map runs through the mean score of each pool."""
        order = np.argsort(s, kind="stable")
        pools: list[list[float]] = []
        for si, yi in zip(s[order], y[order], strict=True):
            pools.append([yi, 1.0, si])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                t = pools.pop()
                pools[-1] = [a + c for a, c in zip(pools[-1], t, strict=True)]
        self.iso_x = np.array([0.0, *[p[2] / p[1] for p in pools], 1.0])
        means = [p[0] / p[1] for p in pools]
        self.iso_y = np.array([means[0], *means, means[-1]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self._raw(binned(x, self.cuts)), self.iso_x, self.iso_y)


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", most: int = TRAIN_ROWS) -> tuple[BoostedTrees, frozenset]:
    """Trees and lexicon from at most `most` labelled rows, chosen by id hash among those not held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null").filter(~held_out)
    ids = sample_bound(known, most)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int").alias("fold")
    check = (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4)) == 0).alias("check")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most `most` ids
    rows = materialize(rows.select("text", "y", fold, check), "sample")
    counts = rows.mapInArrow(word_counts, "fold int, word string, toxic long, clean long").groupBy("fold", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = {r["fold"]: (r["t"], r["n"] - r["t"]) for r in rows.groupBy("fold").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    counts = materialize(counts, "words")
    lexicons = docs.sparkSession.sparkContext.broadcast([lexicon(counts, totals, (1,)), lexicon(counts, totals, (0,))])

    def fitted(batches):
        memo, flags = WordHashes(), [WordFlags(words) for words in lexicons.value]
        for batch in batches:
            x = [dense(t, flags[f], memo) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y"), batch.column("check")], ["x", "y", "check"])

    sample = rows.mapInArrow(fitted, "x array<double>, y int, check boolean").collect()
    width = len(dense(None, WordFlags(frozenset()), WordHashes()))
    x = np.array([r["x"] for r in sample], float).reshape(len(sample), width)
    model = BoostedTrees(x, np.array([r["y"] for r in sample], float), np.array([r["check"] for r in sample], bool))
    return model, lexicon(counts, totals, (0, 1))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (higher: toxic likelier) and predicted (score >= 0.3) for every row of docs.

    Trees, lexicons and calibration learn from labels of rows whose crc32(doc_id as text) mod 4 is not 2, at most
    TRAIN_ROWS of them. Null and empty texts have zero features and get a score like any other. Labels other than 0 and 1
    are ignored; a label stated twice for a doc_id counts once, and contradictory ones count one row each. Without labels of both kinds the score is their smoothed share. Rows without a doc_id are scored and not
    held out; rows repeated exactly get equal scores. Long texts are measured whole. Columns besides doc_id and text are
    ignored, whatever their names; an empty table gives an empty one.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held))  # trees and LEXICON_WORDS words

    def scored(batches):
        model, learned = shared.value
        memo, flags = WordHashes(), WordFlags(learned)
        for batch in batches:
            x = np.array([dense(t.as_py(), flags, memo) for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.predict(x) if len(x) else [], pa.float64())], ["doc_id", "score"])

    out = rows_of(docs, "text").select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
