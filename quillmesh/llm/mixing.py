"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) over its quality weight, from a hash of its identity. A source's target is
met by complete epochs first; the rest takes documents in the order of their keys until the words left are used up, the
last one in part. Prefix sums run in two levels: rows are cut into ranges of their order, sums of ranges are accumulated on
the small table of ranges, and only rows of one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import NONSPACE_WORD, materialize, row_key, spread_join

WEIGHTS = (5, 2, 1)
EPOCHS = 3
RANGE_ROWS = 20_000


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of letters, marks and spaces among the characters; a plain stand-in where no score is given."""
    n = F.char_length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.lit(0.9) * F.regexp_count(text, F.lit(r"[\x21-\x2B\x2F-\x40\x5B-\x60\x7B-\x7F]")) / n)


def running_sums(rows: DataFrame, by: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """rows with before_<value>, the sum of each value over the rows of the same `by` that stand earlier in the order.

    Rows are cut into ranges of the order at borders that Spark samples from the rows themselves, so that ranges are about
    equal however the keys lie; sums of ranges are accumulated, and only rows of one range are sorted together.
    """
    count = rows.count()
    keys = [F.col(c) for c in by] + order
    cut = rows.withColumns({f"__o{i}": c for i, c in enumerate(keys)})
    names = [f"__o{i}" for i in range(len(keys))]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // RANGE_ROWS + 1)
    cut = materialize(cut.repartitionByRange(parts, *names).withColumn("__range", F.spark_partition_id()), "ranges")
    total = {v: F.sum(v) for v in values}
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut.groupBy(*by, "__range").agg(*[s.alias(f"__t_{v}") for v, s in total.items()])
    begins = begins.select(*by, "__range", *[F.coalesce(F.sum(f"__t_{v}").over(ahead), F.lit(0)).alias(f"__b_{v}") for v in values])
    within = Window.partitionBy(*by, "__range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(begins, [*by, "__range"])
    return joined.withColumns({f"before_{v}": F.col(f"__b_{v}") + F.coalesce(s.over(within), F.lit(0)) for v, s in total.items()}).select(*rows.columns, *[f"before_{v}" for v in values])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes(source, source_size, ...) with target.

    Sources by code point, null last, weigh `weights` in turn and share all words; what a source would get beyond `epochs`
    times its size goes to the others by weight until none is above. In closed form: with sources sorted by the size that
    their weight reaches first, the first k are full, and k is the least for which the common level stays below the next;
    later levels are lower. Both orders are running sums over ranges, so sources may be as many as hosts are.
    """
    columns = sizes.columns
    s = running_sums(sizes.withColumn("one", F.lit(1)), [], [F.col("source").isNull(), F.col("source")], ["one"])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("before_one") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * float(epochs))
    s = materialize(running_sums(s, [], [F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")], ["cap", "w"]), "levels")
    everything = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    s = s.withColumn("level", (F.lit(float(everything["all"])) - F.col("before_cap")) / (F.lit(float(everything["w"])) - F.col("before_w")))
    common = s.agg(F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))).first()[0]
    return s.select(*columns, F.least("cap", F.coalesce(F.lit(common).cast("double") * F.col("w"), F.col("cap"))).alias("target"))


def units(docs: DataFrame, quality: str | None = None, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """(doc_id, __k, __s, source, copies, size, source_size, target, taken): a row for all rows equal in doc_id, text and source."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col("text"), F.col("doc_id"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    weight = quality_weight(F.col("text"))
    if quality:
        weight = F.when(F.col(quality) > 0, F.col(quality).cast("double")).otherwise(weight)
    slim = docs.select(
        F.col("doc_id"),
        row_key().alias("__k"),
        source_key().alias("__s"),
        F.col("source"),
        F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(NONSPACE_WORD))).cast("long").alias("size"),
        (-F.log(u) / weight).alias("key"),
    )
    slim = slim.groupBy("doc_id", "__k", "__s", "source", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"))
    slim = materialize(slim.withColumn("words", F.col("size") * F.col("copies")), "mix")
    sources = slim.groupBy("__s", "source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = source_targets(materialize(sources, "sources"), weights, epochs)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("times", times).withColumn("rest", F.floor(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    plan = materialize(plan.drop("source"), "plan")
    rows = running_sums(spread_join(slim, plan, ["__s"]), ["__s"], [F.col("key"), F.col("doc_id"), F.col("__k")], ["words"])
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before_words")))
    return rows.select("doc_id", "__k", "__s", "source", "copies", "size", "source_size", "target", (F.col("times") * F.col("size") + F.floor(part / F.col("copies"))).cast("long").alias("taken"))


def source_key() -> Column:
    """The source as a value that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def mix(docs: DataFrame, quality: str | None = None, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """All rows and columns of docs with size, source_size, target and taken, the words that the mix takes of each.

    size counts runs of other than ASCII white space (0 for a null or empty text; long texts are counted whole). A document
    of a source with target T and size S is taken floor(T / S) times, and once more, whole or in part, if its key comes
    before the remainder is used up; so a source's words come to the floor of its target and no document exceeds `epochs`
    times its size. `quality` names a column of positive weights; where it is missing, null or not positive, the share of
    letters stands in. Keys depend on doc_id, text and seed alone: reruns agree; ties are ordered by doc_id and text hash.
    Rows repeated exactly are taken together and share evenly what is taken of them, less a remainder below their number.
    A null source is a source of its own. Columns of docs named as results are replaced, others stay, whatever their names.
    An empty table gives an empty one.
    """
    new = ("size", "source_size", "target", "taken")
    taken = materialize(units(docs, quality, weights, epochs, seed), "taken")
    own = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(-1)).alias("__d"), row_key().alias("__k"), source_key().alias("__s"))
    keyed = taken.select(F.coalesce("doc_id", F.lit(-1)).alias("__d"), "__k", "__s", F.col("copies").alias("n"), *new)
    joined = spread_join(own, keyed, ["__d", "__k", "__s"])
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *new)


def mix_digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract, one row for each row of docs; the texts are read once."""
    found = units(docs.select("doc_id", "text", "source"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("doc_id", "size", "source_size", "target", "taken", "source")
