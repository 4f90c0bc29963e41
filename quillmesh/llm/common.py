"""Helpers of the document operators: shared scratch tables, row identity and word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts, as Java patterns.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"
NONSPACE_WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Keys with more than one in so many rows are dealt with apart.
HEAVY = 1000

#: The same folding for bytes.translate(): A-Z become a-z.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of the warehouse, or a temporary one if all tasks run in the driver (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        path = "file://" + tempfile.mkdtemp(prefix="spark-scratch-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors.

    The results of operators read such tables lazily, so they stay until the application ends, which deletes them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id (as it is), the row key __k, and the named columns; other columns, whatever their names, stay behind.

    __k hashes the text, so that (doc_id, __k) identifies a row up to exact repeats, also where doc_id is null or not unique.
    """
    return docs.select(F.col("doc_id"), F.xxhash64(F.col("text"), F.col("doc_id")).alias("__k"), *[F.col(c) for c in columns])


def join_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, __k) with null-safe ids; the key columns of the left side stay."""
    r = right.withColumnRenamed("doc_id", "__r_id").withColumnRenamed("__k", "__r_k")
    return left.join(r, (left["__k"] == r["__r_k"]) & left["doc_id"].eqNullSafe(r["__r_id"]), how).drop("__r_id", "__r_k")


def row_key() -> Column:
    """The key __k of rows_of."""
    return F.xxhash64(F.col("text"), F.col("doc_id"))


def wrapped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, __k): whole rows as one struct, so that no column of the caller can clash with one of an operator."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id"), row_key().alias("__k"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The rows of left with the columns of right, which has one row a key and in n how many rows of left have that key.

    Keys are never null. A key with over a HEAVY-th of all rows would fill one task; there are fewer than HEAVY of these,
    whatever the input, so they are broadcast and the others shuffle. Both sides are read twice and should be tables.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(1, total // HEAVY)
    heavy = F.broadcast(right.filter(hot).drop(n))  # fewer than HEAVY rows
    rest = left.join(F.broadcast(right.filter(hot).select(*keys)), keys, "left_anti").join(right.filter(~hot).drop(n), keys)
    return left.join(heavy, keys).unionByName(rest)


def spread_left_join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """All rows of left with the columns of right, null where it lacks their key; heavy keys are dealt with as in spread_join.

    n is about how many rows of left have the key. left is read a second time only if some key is heavy.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(HEAVY, total // HEAVY)
    heavy = right.filter(hot).drop(n)  # fewer than HEAVY rows
    if not heavy.take(1):
        return left.join(right.drop(n), keys, "left")
    rest = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(right.filter(~hot).drop(n), keys, "left")
    return left.join(F.broadcast(heavy), keys).unionByName(rest)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows: the size check before a broadcast."""
    return len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if fits(df, rows) else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() serves texts that are ASCII throughout."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def alnum_words(text: Column) -> Column:
    """The array of lower-cased words; null texts have none. Splitting costs a third of extracting the words one by one."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def nonspace_words(text: Column) -> Column:
    """The array of words between ASCII white space; null texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def placed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, __k, all, h, pos, x): a row for each word, with all words and their hashes at hand; one with null pos for a text without words."""
    rows = rows_of(docs, "text").select("doc_id", "__k", alnum_words(F.col("text")).alias("all"))
    rows = rows.withColumn("h", F.transform("all", lambda w: F.xxhash64(w)))
    return rows.select("doc_id", "__k", "all", "h", F.posexplode_outer("h").alias("pos", "x"))


def gram_at(hashes: Column | str, at: Column, size: int) -> Column:
    """Hash of the hashes of `size` words from place `at`, counted from 0."""
    return F.xxhash64(F.lit(size), *[F.get(hashes, at + i) for i in range(size)])


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered for up to `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def flat(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all documents, end to end, and the number of words of each."""
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(docs)), np.uint64, int(lens.sum())), lens


def chunks(batches: Iterable, text_column: str, most_bytes: int = 4_000_000):
    """Slices of the Arrow batches with about so many bytes of text each, so that memory does not follow the batch size."""
    for batch in batches:
        col = batch.column(text_column)
        start = size = 0
        for i in range(batch.num_rows):
            size += len(col[i].as_buffer() or b"") if col[i].is_valid else 0
            if size >= most_bytes:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(x: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Order-sensitive hashes of all runs of `width` neighbours of x, by joining runs of 1, 2, 4 ... neighbours."""
    mul = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    run, size = mix64(x + np.uint64(seed)), 1
    whole, done, rest = None, 0, width
    while rest:
        if rest & 1:
            if whole is None:
                whole, done = run, size
            else:
                n = max(0, len(x) - done - size + 1)
                whole = mix64(whole[:n] * mul + run[done : done + n])
                done += size
        rest >>= 1
        if rest:
            n = max(0, len(x) - 2 * size + 1)
            run = mix64(run[:n] * mul + run[size : size + n])
            size *= 2
    return whole


def sliding(x: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over all runs of `width` neighbours."""
    run, size = x, 1
    while size * 2 <= width:
        n = max(0, len(run) - size)
        run = op(run[:n], run[size : size + n])
        size *= 2
    if size < width:
        n = max(0, len(x) - width + 1)
        run = op(run[:n], run[width - size : width - size + n])
    return run
