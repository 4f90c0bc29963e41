"""Language ID by bit-sliced Bloom filters of character n-grams.

Every cell of the filter holds one bit a language; the bits that all cells of an n-gram share are the languages whose
filter contains it, so one look-up answers for all languages. A text's n-grams are counted for each language, the counts
are corrected for the filter's false positives, and the largest decides.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import materialize, mix64, rows_of, small_side

GRAM = 4
GRAMS_A_LANGUAGE = 8_000
TRAIN_DOCS_A_LANGUAGE = 4_000
CELLS = 1 << 20
HASHES = 3
WORD_BITS = 64
BROADCAST_LANGUAGES = 100_000
UNDETERMINED = "und"
BLANK = 32


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams_of(text: str | None) -> np.ndarray:
    """Hashes of all character n-grams of a text's letters, lower-cased, other runs being one blank; empty without a letter."""
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letter_table()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    kept = np.where(letter, points, BLANK)
    kept = kept[letter | np.append(True, letter[:-1])]
    kept = np.concatenate([[BLANK], kept, [BLANK] * GRAM])[: max(GRAM, len(kept) + 2)].astype(np.uint64)
    code = kept[: len(kept) - GRAM + 1]
    for i in range(1, GRAM):
        code = code * np.uint64(0x1F0A3D7B5C91) + kept[i : len(kept) - GRAM + 1 + i]
    return mix64(code)


def _cells(gram: np.ndarray, i: int) -> np.ndarray:
    """The i-th cell of each n-gram: double hashing with both halves of its hash."""
    return (gram + np.uint64(i) * (gram >> np.uint64(32) | np.uint64(1))) & np.uint64(CELLS - 1)


def _gram_counts(batches):
    for batch in batches:
        of: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            of.setdefault(lang, []).append(grams_of(text))
        for lang, parts in of.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64), pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def training_rows(docs: DataFrame, per_language: int = TRAIN_DOCS_A_LANGUAGE) -> DataFrame:
    """(lang, text) of about per_language rows of each language, chosen by a hash of their ids; rows held out never take part."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = small_side(materialize(sizes, "languages"), BROADCAST_LANGUAGES)
    share = F.lit(float(per_language)) / F.col("n")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0
    return known.join(sizes, "lang").filter(draw < share).select("lang", "text")


class BloomModel:
    """Languages in order, the bits of all of them in each cell, and each one's false positive rate.

    Up to 64 languages take one number a cell, more take a row of several: CELLS * 8 bytes for each 64 languages.
    """

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages = languages
        width = next((w for w in (8, 16, 32) if len(languages) <= w), WORD_BITS)
        words = -(-len(languages) // width)
        self.cells = np.zeros((CELLS, words) if words > 1 else CELLS, f"<u{width // 8}")
        fill = []
        for i, of in enumerate(grams):
            word = self.cells[:, i // width] if words > 1 else self.cells
            bit = i % width
            for h in range(HASHES):
                word[_cells(of, h)] |= word.dtype.type(1 << bit)
            fill.append((word >> word.dtype.type(bit) & word.dtype.type(1)).mean())
        self.false_rate = np.array(fill) ** HASHES

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a text and the corrected share of its n-grams that the language has."""
        gram = grams_of(text)
        if not len(gram) or not self.languages:
            return UNDETERMINED, 0.0
        counts = np.zeros(len(self.languages), np.int64)
        for at in range(0, len(gram), 65_536):
            part = gram[at : at + 65_536]
            mask = self.cells[_cells(part, 0)]
            for h in range(1, HASHES):
                mask &= self.cells[_cells(part, h)]
            bits = np.unpackbits(mask.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)[: len(self.languages)]
        share = (counts / len(gram) - self.false_rate) / (1 - self.false_rate)
        best = int(np.argmax(share))
        return self.languages[best], float(np.clip(share[best], 0, 1))


def train(docs: DataFrame, per_language: int = TRAIN_DOCS_A_LANGUAGE, grams_each: int = GRAMS_A_LANGUAGE) -> BloomModel:
    """A model from the n-grams most frequent in each language; grams_each n-grams of every language come to the driver."""
    counts = training_rows(docs, per_language).mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    grams = []
    for lang in languages:
        top = counts.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(grams_each)
        grams.append(np.array([r["gram"] for r in top.select("gram").collect()], np.int64).view(np.uint64))
    return BloomModel(languages, grams)


def _predicted(model):
    def run(batches):
        m = model.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__k"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "__k", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: BloomModel | None = None) -> DataFrame:
    """doc_id, __k, lang_pred, score for every row of docs.

    A null text, an empty one and one without a letter get "und" and score 0, as does every text where nothing could be
    learned. Ties go to the language that comes first by code point. Training uses text and lang of rows with both, up to
    TRAIN_DOCS_A_LANGUAGE rows a language, and learns every lang value among them; other columns, whatever their names, are ignored. Long texts are
    counted in slices and judged whole. Rows repeated exactly get equal results; an empty table gives an empty one.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS * 8 bytes for each 64 languages
    return rows_of(docs, "text").mapInArrow(_predicted(shared), "doc_id long, __k long, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract; rows without a doc_id are not held out, nor are they learned from."""
    return predict(docs).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_recognised(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """The rows of docs with a predicted language and a score of at least `least`, with all their columns, whatever their names.

    Null texts and those without a letter go; long texts are judged whole; rows repeated exactly fare alike. An empty
    table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    names = docs.columns

    def run(batches):
        m = model.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*names)
