"""JSON lines, lists of ids and nested responses as sources, and JSON lines as a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """SK3: one compact JSON object a line, nulls written; Spark's committer renames finished parts only."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """SC2: the objects of JSON lines; blank lines are skipped, a malformed one is an error when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def find_record(rows: DataFrame, key: str, value) -> DataFrame:
    """SC3: the rows with that key; an error if there is none."""
    found = rows.filter(F.col(key) == value)
    if not found.take(1):
        raise KeyError(f"no record with {key} = {value!r}")
    return found


def listed_ids(lists: DataFrame) -> DataFrame:
    """SC6: (id, place) of lists(list, line_no, line): without comments after # and blanks, each id at its first place."""
    ids = lists.withColumn("id", F.trim(F.regexp_replace("line", "#.*$", ""))).filter("id <> ''")
    return ids.groupBy("id").agg(F.min(F.struct("list", "line_no")).alias("place"))


def dotted(json: Column, path: str) -> Column:
    """SC7, JS2: the value at a dotted path of a JSON text, null where any step is missing."""
    return F.get_json_object(json, "$." + path)


def truncated(values: Column, cap: int = 1000) -> Column:
    """SC13: whether a nested list has reached the cap of the response it came in."""
    return F.coalesce(F.size(values) >= cap, F.lit(False))


def read_xml_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """SC8: the XML elements of files with one a line; attributes have names that begin with _, a malformed element is an error when it is read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_xml("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def paged(pages: DataFrame, key: str, offset: str, items: str) -> DataFrame:
    """SC11: (key, place, item) of lists that came in pages, places counted from 0 over all pages of a key; null pages have none."""
    rows = pages.select(key, F.col(offset).alias("__o"), F.posexplode(F.coalesce(F.col(items), F.array().cast("array<string>"))).alias("pos", "item"))
    return rows.select(key, (F.col("__o") + F.col("pos")).cast("long").alias("place"), "item")
