"""Spelling variants: words one edit apart, found through a forward and a reversed dictionary.

One edit leaves a half of a word intact: of two words, the shorter of m letters, either the first m // 2 letters stand
first in both, or the other m - m // 2 stand last in both. So each word is entered in a dictionary sorted by first halves
and in one sorted by last halves, once for partners as long or longer and once for shorter ones; words that share a half
are a block, neighbours in the sorted order, and blocks are read by range scans. A block of more than `most` words is
subdivided: the edit lies in the part of the word that is still open, and leaves a half of that intact in turn, so each of
its words enters two narrower blocks. When one letter is open a block is as small as the alphabet allows. A pair that
shares both halves belongs to the first one alone, by the length of its common beginning, so no pair is found twice.
Within a block words are held against their followers in the scan, letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import LOWER_BYTES, chunks, materialize, spread_join
from quillmesh.llm.sharding import CRC_TABLE, crc_sql

LETTERS = re.compile("[a-zÀ-ÿ]+")
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a letter, by its checksum.
NOISE = 31
MOST = 128
#: Distinct (document, run) pairs that a task gathers before it sends their counts.
HELD = 500_000


def _runs(text: bytes | None, most: int = 4_000_000) -> Counter:
    """The lower-cased runs of a whole text with their counts; those of a long text are met one at a time."""
    whole = (text or b"").translate(LOWER_BYTES).decode("utf-8", "replace")
    return Counter(LETTERS.findall(whole) if len(whole) <= most else (m.group() for m in LETTERS.finditer(whole)))


def spelled(doc: int | None, run: str, noise: int = NOISE) -> str:
    """The run as the document counts it: without one letter if `noise` divides the checksum of doc_id and run."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    return run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(least: int, noise: int):
    def flush(held):
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for part in chunks(batches, "text"):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in _runs(text.as_py()).items():
                    if len(word) >= least:
                        h = zlib.crc32(word.encode(), prefix)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        held[word] += n
                if len(held) >= HELD:
                    yield from flush(held)
                    held = Counter()
        if held:
            yield from flush(held)

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): the words of at least so many letters and occurrences; tasks count before the shuffle, so a frequent word is one row a task."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    counts = texts.mapInArrow(_counted(least_letters, noise), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def entered(words: DataFrame) -> DataFrame:
    """(m, lo, hi, word, n): each word in the first-half and the last-half dictionary, for partners as long or longer (m letters) and shorter ones (m - 1)."""
    length = F.char_length("word")
    m = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).filter("m > 0")
    half = F.floor(F.col("m") / 2).cast("int")
    return m.select("word", "n", "m", F.explode(F.array(F.struct(half.alias("lo"), F.col("m").alias("hi")), F.struct(F.lit(0).alias("lo"), half.alias("hi")))).alias("open")).select("m", "open.lo", "open.hi", "word", "n")


def subdivided(entries: DataFrame) -> DataFrame:
    """The entries of blocks that are too large, each in its two narrower blocks."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi")))
    return entries.select("m", F.explode(halves).alias("open"), "word", "n").select("m", "open.lo", "open.hi", "word", "n")


def kept_half() -> Column:
    """What all words of a block share: their first lo and their last m - hi letters, in the order of the dictionary they are sorted in."""
    last = F.reverse(F.col("word")).substr(F.lit(1), F.col("m") - F.col("hi"))
    return F.concat_ws("|", F.col("word").substr(F.lit(1), F.col("lo")), last)


def _first_other(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows of a and b."""
    other = a != b
    return np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])


def near_rows(words: np.ndarray, long: np.ndarray, group: np.ndarray, hi: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group that are one edit apart, counted in this block and no other.

    words: letters of each row, m + 1 columns, padded with 0; long: whether a row has m + 1 letters rather than m; rows of
    a group stand together. Pairs of two long rows belong to the blocks of m + 1.
    """
    left, right = [], []
    sizes = np.bincount(group) if len(group) else np.zeros(1, int)
    at = np.arange(len(words))
    for step in range(1, int(sizes.max(initial=0))):
        at = at[: np.searchsorted(at, len(words) - step)]
        at = at[group[at] == group[at + step]]  # a row without a follower so far off has none farther off
        i = at[~(long[at] & long[at + step])]
        j = i + step
        same = long[i] == long[j]
        a, b = i[same], j[same]
        other = words[a, :m] != words[b, :m]
        one = other.sum(axis=1) == 1
        one[one] = (other[one].argmax(axis=1) < hi[a[one]]) | (hi[a[one]] == m)
        left.append(a[one]), right.append(b[one])
        s, b = np.where(long[i], j, i)[~same], np.where(long[i], i, j)[~same]
        head = _first_other(words[s, :m], words[b, :m])
        tail = _first_other(words[s, :m][:, ::-1], words[b, 1 : m + 1][:, ::-1])
        one = (head + tail >= m) & ((head < hi[s]) | (hi[s] == m))
        left.append(s[one]), right.append(b[one])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


PAIR = ["word", "near", "n_near_word"]


def _scan(batches):
    """Near pairs, both ways, of blocks that arrive sorted; whole blocks are held, about a million letters at a time."""

    def found(rows: list[tuple]):
        m = rows[0][0]
        width = m + 1
        words = np.zeros((len(rows), width), np.uint8)
        for k, r in enumerate(rows):
            code = r[4].encode("latin-1")
            words[k, : len(code)] = np.frombuffer(code, np.uint8)
        long = words[:, m] > 0
        keys = [r[:4] for r in rows]
        group = np.cumsum([k > 0 and keys[k] != keys[k - 1] for k in range(len(rows))])
        i, j = near_rows(words, long, group, np.array([r[2] for r in rows], np.int64), m)
        text, count = [r[4] for r in rows], [r[5] for r in rows]
        one, two = np.concatenate([i, j]).tolist(), np.concatenate([j, i]).tolist()
        return pa.RecordBatch.from_arrays([pa.array([text[k] for k in one], pa.string()), pa.array([text[k] for k in two], pa.string()), pa.array([count[k] for k in two], pa.int64())], PAIR)

    held: list[tuple] = []
    letters, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("m", "lo", "hi", "half", "word", "count")), strict=True):
            block = row[:4]
            if held and block != last and (letters > 1_000_000 or row[0] != held[0][0]):
                yield found(held)
                held, letters = [], 0
            held.append(row)
            letters += row[0] + 1
            last = block
    if held:
        yield found(held)


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, n_near_word): every two of words(word, n) that differ by one letter inserted, deleted or replaced, both ways.

    Words are distinct and of code points up to 255. The rows are as many as there are such pairs: a word of m letters has at most about
    180 (m + 1) neighbours, whatever the vocabulary.
    """
    found, entries, key = None, entered(words), ["m", "lo", "hi", "half"]
    while True:
        entries = entries.withColumn("half", kept_half())
        blocks = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("n", F.col("size"))
        blocks = materialize(blocks.withColumn("large", (F.col("size") > most) & (F.col("hi") - F.col("lo") > 1)), "blocks")
        # a block may hold a third of all entries: these meet its size in a broadcast and are never gathered
        placed = materialize(spread_join(entries.withColumnRenamed("n", "count"), blocks.drop("size"), key), "placed")
        pairs = placed.filter("not large").repartitionByRange(*key).sortWithinPartitions(*key, "word").mapInArrow(_scan, "word string, near string, n_near_word long")
        found = pairs if found is None else found.unionByName(pairs)
        if not blocks.filter("large").take(1):
            return found
        entries = subdivided(placed.filter("large").withColumnRenamed("count", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the end of each chain, by doubling steps; counts grow along a chain, so there are no circles."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        beyond = found.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ahead = materialize(found.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        found = ahead.select("word", "root")
        if not ahead.filter("moved").take(1):
            return found


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of words(word, n), whose words are distinct.

    A word's form is the near word of largest n, ties to the first in code-point order, if that n is at least `ratio` times its own. An
    empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent, so that chains of forms end")
    words = materialize(words, "words")
    best = F.min(F.struct((-F.col("n_near_word")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    far = F.col("best.less") * -1 >= F.col("n") * ratio
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n"))
    found = materialize(found, "near")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract.

    Null and empty texts have no words; whole texts are read, however long. A null doc_id is written as nothing in the
    checksum. Repeated rows count each. Columns besides doc_id and text are ignored; an empty table gives an empty one.
    """
    return variants(vocabulary(docs))


def variant_groups(found: DataFrame) -> DataFrame:
    """(root, n_words, n) of the groups of two words and more: how many spellings a root has, and their occurrences."""
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n")).filter("n_words > 1")


def spelling_sql() -> str:
    """By deletion: two words are near if they are equal without one letter each, at one place, or one is the other without a letter."""
    return f"""WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{RUN}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
drawn AS (SELECT run, n, {crc_sql("encode(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM once, crc),
spelled AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM drawn),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, i, substring(word, 1, i::INT) || substring(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
near AS (SELECT p.word, count(*) AS n_near, max(w.n) AS most FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
named AS (SELECT p.word, min(p.near) AS near FROM pairs p JOIN words w ON w.word = p.near JOIN near ON near.word = p.word WHERE w.n = near.most GROUP BY p.word),
found AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * w.n THEN named.near END AS form, CASE WHEN most >= {RATIO} * w.n THEN most END AS form_n FROM words w LEFT JOIN near USING (word) LEFT JOIN named USING (word)),
chain AS (SELECT word, form AS at FROM found WHERE form IS NOT NULL UNION ALL SELECT chain.word, found.form FROM chain JOIN found ON found.word = chain.at WHERE found.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN found ON found.word = chain.at WHERE found.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near::BIGINT AS n_near, form_n FROM found LEFT JOIN ends USING (word)"""
