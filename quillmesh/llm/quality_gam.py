"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature at a time, each adding to that feature's look-up table over bins; pairs of
features that explain most of what is left get two-way tables the same way. A score is a sum of table entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import WordHashes, materialize, rows_of
from quillmesh.llm.shape import NAMES, binned, cut_points, sample_bound, shape, sigmoid

TRAIN_ROWS = 20_000
BINS = 32
CYCLES = 120
PAIRS = 6
PAIR_CYCLES = 40
RATE = 0.1
LEAST_WEIGHT = 2.0


def _gain(g, h):
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best single cut of a histogram; place 0 if none is allowed."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    ok = (hl >= LEAST_WEIGHT) & (h.sum() - hl >= LEAST_WEIGHT)
    if not ok.any():
        return 0.0, 0
    gain = np.where(ok, _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum()), -1.0)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values by bin of a tree of up to `leaves` leaves, grown where the gain is largest."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(cuts)
        if not at or gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by cell: one cut of the first axis, then one of the second on either side."""
    _, at = _best_cut(g.sum(axis=1), h.sum(axis=1))
    out = np.zeros(g.shape)
    for part in (slice(0, at), slice(at, g.shape[0])) if at else (slice(0, g.shape[0]),):
        out[part] = _tree(g[part].sum(axis=0), h[part].sum(axis=0), 2)[None, :]
    return out


class AdditiveModel:
    """Borders, one table a feature, and tables of chosen pairs over coarser bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts, self.coarse = cut_points(x, BINS), cut_points(x, 8)
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        if len(y) < 20 or y.min() == y.max():
            return
        fine, wide = binned(x, self.cuts), binned(x, self.coarse)
        score = np.full(len(y), self.prior)
        for _ in range(CYCLES):
            for j, table in enumerate(self.tables):
                p = sigmoid(score)
                step = RATE * _tree(np.bincount(fine[:, j], y - p, len(table)), np.bincount(fine[:, j], p * (1 - p), len(table)))
                table += step
                score += step[fine[:, j]]
        p = sigmoid(score)
        found = []
        for a in range(x.shape[1]):
            for b in range(a + 1, x.shape[1]):
                g, h = self._grid(wide, a, b, y - p), self._grid(wide, a, b, p * (1 - p))
                found.append((float(_gain(g, h).sum()), a, b))
        for _, a, b in sorted(found, reverse=True)[:PAIRS]:
            self.pairs[a, b] = np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1))
        for _ in range(PAIR_CYCLES):
            for (a, b), table in self.pairs.items():
                p = sigmoid(score)
                step = RATE * _pair_tree(self._grid(wide, a, b, y - p), self._grid(wide, a, b, p * (1 - p)))
                table += step
                score += step[wide[:, a], wide[:, b]]

    def _grid(self, wide: np.ndarray, a: int, b: int, weight: np.ndarray) -> np.ndarray:
        rows, cols = len(self.coarse[a]) + 1, len(self.coarse[b]) + 1
        return np.bincount(wide[:, a] * cols + wide[:, b], weight, rows * cols).reshape(rows, cols)

    def predict(self, x: np.ndarray) -> np.ndarray:
        fine, wide = binned(x, self.cuts), binned(x, self.coarse)
        score = np.full(len(x), self.prior)
        for j, table in enumerate(self.tables):
            score += table[fine[:, j]]
        for (a, b), table in self.pairs.items():
            score += table[wide[:, a], wide[:, b]]
        return sigmoid(score)


def _shapes(batches):
    memo = WordHashes()
    for batch in batches:
        rows = [shape(t.as_py(), memo) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__k"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "__k", "x"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, __k, x): the shape features of whole texts."""
    return rows_of(docs, "text").withColumn("text", F.col("text").cast("binary")).mapInArrow(_shapes, "doc_id long, __k long, x array<double>")


def train(shapes: DataFrame, labels: DataFrame, held_out, label: str = "quality", most: int = TRAIN_ROWS) -> AdditiveModel:
    """A model from at most `most` labelled rows, chosen by id hash among those not held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(f"y in (0, 1) and doc_id is not null").filter(~held_out)
    ids = F.broadcast(materialize(sample_bound(known, most), "sample"))  # at most `most` ids
    rows = shapes.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id", "y").collect()  # one row where ids repeat in docs
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(NAMES))
    return AdditiveModel(x, np.array([r["y"] for r in rows], float))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (higher: quality 1 likelier) and predicted (score >= 0.3) for every row of docs.

    The model learns from labels of rows whose crc32(doc_id as text) mod 5 is not 0, at most TRAIN_ROWS of them; its inputs
    are shape features of the whole text. Null and empty texts have zero features and get a score like any other. Labels
    other than 0 and 1 are ignored; a label stated twice for a doc_id counts once, and
    contradictory ones count one row each. Without labels of both kinds the score is
    their smoothed share. Rows without a doc_id are scored and not held out; rows repeated exactly get equal scores. Long
    texts are measured whole. Columns besides doc_id and text are ignored, whatever their names; an empty table gives an
    empty one.
    """
    shapes = materialize(features(docs), "shapes")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(train(shapes, labels, held))  # tables of a few kilobytes

    def scored(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.predict(flat), pa.float64())], ["doc_id", "score"])

    out = shapes.select("doc_id", "x").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
