"""JN10: records merged by the first key that an earlier record has, where each record's keys count for those after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import settled


def _before(keyed: DataFrame) -> DataFrame:
    """keyed(rank, key, at, id) with `prior`, the id of the last row before it in `at` that has the same key.

    A key may be that of most rows: rows are cut into ranges of (rank, key, at), looked through within a range, and only the first row
    of a range looks into the ranges before it, of which there are as many as partitions.
    """
    cut = settled(keyed.repartitionByRange("rank", "key", "at").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part", "rank", "key").orderBy("at")
    here = cut.withColumn("prior", F.lag("id").over(within))
    ends = cut.groupBy("rank", "key", "part").agg(F.min("at").alias("at"), F.max(F.struct("at", "id"))["id"].alias("last"))
    across = ends.withColumn("outside", F.lag("last").over(Window.partitionBy("rank", "key").orderBy("part"))).filter("outside is not null")
    firsts = here.filter("prior is null").drop("prior").join(across.select("rank", "key", "at", "outside"), ["rank", "key", "at"], "left")
    return here.filter("prior is not null").select("rank", "id", "prior").unionByName(firsts.select("rank", "id", F.col("outside").alias("prior")))


def merge_groups(rows: DataFrame, id_: str, order: list[str], keys: list[Column]) -> DataFrame:
    """(id, root): the record that each row of rows is merged into, itself where it is new.

    Rows are taken by (order, id), ids are distinct and not null. A row goes where the last row before it went that has its first
    key; if there is none its second key counts, and so on. Null keys match nothing. That is what a loop finds that enters the
    keys of every row into an index; here each row points at an earlier one and pointers are doubled, so that a chain of n rows takes
    log n rounds. Each round is written to the shared folder and only rows that have not arrived take part in the next.
    """
    placed = rows.select(F.col(id_).alias("id"), F.struct(*order, id_).alias("at"), F.array(*[F.struct(F.lit(i).alias("rank"), k.cast("string").alias("key")) for i, k in enumerate(keys)]).alias("k"))
    keyed = placed.select("id", "at", F.explode("k").alias("k")).select("id", "at", "k.rank", "k.key").filter("key is not null")
    first = _before(keyed).filter("prior is not null").groupBy("id").agg(F.min(F.struct("rank", "prior"))["prior"].alias("to"))
    roots = placed.select("id").join(first, "id", "left_anti").select("id", F.col("id").alias("root"))
    done = [settled(roots)]
    ways = settled(first)
    known = done[0]
    while True:
        arrived = ways.join(known.select(F.col("id").alias("to"), "root"), "to").select("id", "root")
        arrived = settled(arrived)
        done.append(arrived)
        rest = ways.join(arrived.select("id"), "id", "left_anti")
        # the target of a row that has not arrived may have arrived just now, or points on
        ways = settled(rest.alias("a").join(ways.select(F.col("id").alias("to"), F.col("to").alias("on")), "to").select("id", F.col("on").alias("to")))
        known = known.unionByName(arrived)
        if ways.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def merged_records(rows: DataFrame, id_: str, order: list[str], keys: list[Column], fields: list[str], lists: list[str] = ()) -> DataFrame:
    """JN10: one row a record that is left: its id, of each field the first value that is not null, of each list all items once, by first place, and how many rows it is made of."""
    groups = merge_groups(rows, id_, order, keys).withColumnRenamed("id", id_)
    both = rows.join(groups, id_)
    at = F.struct(*order, id_)
    filled = [F.min(F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    records = both.groupBy("root").agg(*filled, F.count(F.lit(1)).alias("n_rows")).withColumnRenamed("root", id_)
    for name in lists:
        items = both.select("root", at.alias("at"), F.posexplode(name).alias("pos", "item")).groupBy("root", "item").agg(F.min(F.struct("at", "pos")).alias("first"))
        whole = items.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "item"))), lambda x: x["item"]).alias(name))
        records = records.join(whole.withColumnRenamed("root", id_), id_, "left")
    return records
