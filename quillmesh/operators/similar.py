"""Names alike by matching blocks: a join on segments, by the pigeonhole principle, and an exact check.

The ratio of two names is twice the letters in their matching blocks over all letters. Matching blocks are a common
subsequence, so a ratio of `least` leaves at most (1 - least) of all letters to insert or delete, d of them. A name cut
into d + 1 segments keeps one of these whole, at a place shifted by no more than d: known names are filed under their
segments, and an asked name is looked up under its own substrings of the same length around the same place. What is looked
up grows with a name's length, not with its neighbours; only names that share a segment are compared.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def ratio(known: str, asked: str) -> float:
    """Matching blocks of two names, longest first."""
    return SequenceMatcher(None, known, asked).ratio()


def _ratios(batches):
    for batch in batches:
        score = [ratio(k, a) for k, a in zip(batch.column("known").to_pylist(), batch.column("asked").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "ratio"])


def _edits(least: float):
    """How many letters of two names of lengths n and m may lie outside matching blocks."""
    return F.floor((F.col("n") + F.col("m")) * (1 - least) + 1e-9).cast("int")


def _segments(rows: DataFrame) -> DataFrame:
    """rows(m, d, ...) with part, at and size of each of the d + 1 segments of a name of m letters."""
    k = F.col("d") + 1
    cut = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("d"))))
    at = lambda i: F.floor(i * F.col("m") / k).cast("int")
    return cut.withColumn("at", at(F.col("part"))).withColumn("size", at(F.col("part") + 1) - F.col("at"))


def similar_names(asked: DataFrame, known: DataFrame, by: list[str], least: float = 0.9) -> DataFrame:
    """(by, asked, known, ratio) of asked(by, asked) and known(by, known), whose ratio is at least `least` (over a half); rows may repeat and are taken once."""
    bounds = lambda c: F.sequence(F.ceil(F.col(c) * least / (2 - least) - 1e-9).cast("int"), F.floor(F.col(c) * (2 - least) / least + 1e-9).cast("int"))
    filed = known.select(*by, "known").distinct().withColumn("m", F.char_length("known")).filter("m > 0")
    filed = filed.withColumn("n", F.explode(bounds("m"))).withColumn("d", _edits(least)).select(*by, "known", "m", "d").distinct()
    filed = _segments(filed).select(*by, "known", "m", "d", "part", F.substring("known", F.col("at") + 1, F.col("size")).alias("segment"))
    looked = asked.select(*by, "asked").distinct().withColumn("n", F.char_length("asked")).filter("n > 0")
    looked = _segments(looked.withColumn("m", F.explode(bounds("n"))).withColumn("d", _edits(least)))
    looked = looked.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("d")), F.greatest(F.lit(0), F.col("at") + F.col("d"))))).filter(F.col("at") + F.col("size") <= F.col("n"))
    looked = looked.select(*by, "asked", "m", "d", "part", F.substring("asked", F.col("at") + 1, F.col("size")).alias("segment")).distinct()
    pairs = looked.join(filed, [*by, "m", "d", "part", "segment"]).select(*by, "asked", "known").distinct()
    return pairs.mapInArrow(_ratios, StructType([*pairs.schema.fields, StructField("ratio", DoubleType())])).filter(F.col("ratio") >= least)


def closest_names(asked: DataFrame, known: DataFrame, by: list[str], n: int = 3, least: float = 0.9) -> DataFrame:
    """The n most alike known names of each asked one, of equally alike ones the last by code point first."""
    order = Window.partitionBy(*by, "asked").orderBy(F.desc("ratio"), F.desc("known"))
    return similar_names(asked, known, by, least).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
