"""SC4: the folders of converted papers below roots, and the files of each, from a listing of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIST, TEXT = "_content_list.json", ".md"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(root, path) of all files below a root, paths relative to it; only names are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    top = "/" + re.escape(root.split("://", 1)[-1].strip("/")) + "/"
    return found.select(F.lit(root.rstrip("/")).alias("root"), F.element_at(F.split("path", top, 2), -1).alias("path"))


def _base(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def paper_folders(files: DataFrame) -> DataFrame:
    """(root, folder, paper_id, content_list, markdown) of files(root, path).

    The folder `vlm` of a root counts if it has files, else the root itself if a content list or Markdown lies right in it, else
    every `*/vlm`. A paper is called like the folder above; its files are those of its name, else the first of their kind by name, null
    where there is none. Folders without files are not in a listing and not seen; rows without a root or path are left out.
    """
    rows = files.filter("root is not null and path is not null").select("root", F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1).alias("folder"), _base(F.col("path")).alias("name"))
    is_list, is_text = F.col("name").endswith(LIST), F.col("name").endswith(TEXT)
    kinds = rows.groupBy("root").agg(F.bool_or((F.col("folder") == "vlm") | F.col("folder").startswith("vlm/")).alias("has_vlm"), F.bool_or((F.col("folder") == "") & (is_list | is_text)).alias("has_own"))
    wanted = F.when(F.col("has_vlm"), F.col("folder") == "vlm").when(F.col("has_own"), F.col("folder") == "").otherwise(F.col("folder").rlike("^[^/]+/vlm$"))
    above = F.when(F.col("folder") == "vlm", _base(F.col("root"))).when(F.col("folder") == "", F.coalesce(F.get(F.reverse(F.split("root", "/")), F.lit(1)), F.lit(""))).otherwise(F.substring_index("folder", "/", 1))
    own = rows.join(kinds, "root").filter(wanted).withColumn("paper_id", above)
    first = lambda of, ending: F.min(F.when(of, F.struct((F.col("name") != F.concat("paper_id", F.lit(ending))).alias("other"), F.col("name").alias("name"))))["name"]
    return own.groupBy("root", "folder", "paper_id").agg(first(is_list, LIST).alias("content_list"), first(is_text, TEXT).alias("markdown"))
