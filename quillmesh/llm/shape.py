"""Shape features of one text, and small numpy learners over binned features."""

from __future__ import annotations

import numpy as np

from quillmesh.llm.common import LOWER_BYTES, WordHashes, rolled

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _SYMBOL, _SHOUT, _PUNCT, _LEAD, _REST = range(10)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _PUNCT, np.uint8)
    table[[9, 11, 12, 13, 32]] = _SPACE
    table[10] = _LINE
    table[48:58] = _DIGIT
    table[65:91] = _UPPER
    table[97:123] = _LOWER
    table[list(b"#*$%&|<>")] = _SYMBOL
    table[list(b"!?")] = _SHOUT
    table[128:192] = _REST
    table[192:] = _LEAD
    return table


CLASSES = _byte_classes()
NAMES = ("log_words", "word_length", "capitals", "symbols", "shouts", "punctuation", "digits", "short_words", "variety", "repeated_lines", "repeated_runs", "line_words", "longest_word", "letters")


def shape(text: bytes | None, memo: WordHashes) -> list[float]:
    """The features NAMES of a whole text; all zero for a null text and one without words."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(NAMES)
    kinds = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=10).astype(float)
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    chars = max(1.0, kinds.sum() - kinds[_SPACE] - kinds[_LINE] - kinds[_REST])
    letters = kinds[_LOWER] + kinds[_UPPER] + kinds[_LEAD]
    lines = [x for x in text.split(b"\n") if x.strip()]
    runs = rolled(memo.flat([words])[0], 6) if n >= 6 else np.zeros(0, np.uint64)
    return [
        float(np.log(n)),
        chars / n,
        kinds[_UPPER] / max(1.0, letters),
        kinds[_SYMBOL] / n,
        kinds[_SHOUT] / n,
        kinds[_PUNCT] / n,
        kinds[_DIGIT] / chars,
        float((lens <= 3).mean()),
        float(np.log(len(set(words))) / np.log(n)) if n > 1 else 1.0,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(np.unique(runs)) / len(runs) if len(runs) else 0.0,
        n / max(1, len(lines)),
        float(lens.max()),
        letters / chars,
    ]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner quantile borders of each feature, without repeats."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(cuts)), np.int64)


def sample_bound(ids, most: int):
    """The `most` rows of ids(doc_id, ...) of least id hash: a bounded, repeatable sample.

    Where there are more rows, a threshold on the hash first leaves about that many in all tasks together, so that no task
    sends more than its share to the top-k.
    """
    from pyspark.sql import functions as F

    n, draw = ids.count(), F.xxhash64("doc_id", F.lit(3))
    if n > most:
        least = 1.2 * most / n + 100 / n
        ids = ids.filter(draw < F.lit(int(min(1.0, least) * ((1 << 64) - 2)) - (1 << 63)))
    return ids.orderBy(draw, "doc_id").limit(most)
