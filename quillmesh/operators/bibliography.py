"""References and citations: the index of mentions, comparisons of sources, look-ups of citations, and positions in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as t
from quillmesh.operators.similar import closest_names

MOST_RANGE = 50


def keyed_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with key and key_type: the bare title, else the bare reference; those that have neither are left out."""
    title, raw = t.loose(F.col("title")), t.loose(F.col("raw"))
    has = F.coalesce(title, F.lit("")) != ""
    return mentions.withColumn("key", F.when(has, title).otherwise(raw)).withColumn("key_type", F.when(has, "title").otherwise("raw")).filter("key <> ''")


def reference_index(mentions: DataFrame) -> DataFrame:
    """AG1, AG4: (key, key_type, mention_count, citing_paper_count, first_paper, n_years) of all mentions."""
    return keyed_mentions(mentions).groupBy("key", "key_type").agg(
        F.count(F.lit(1)).alias("mention_count"), F.countDistinct("paper_id").alias("citing_paper_count"), F.min("paper_id").alias("first_paper"), F.countDistinct("year").alias("n_years")
    )


def top_values(mentions: DataFrame, column: str, n: int) -> DataFrame:
    """AG2, AG3: (key, values) with the n most frequent values of a column for each key; ties go to the one seen first.

    Values are counted before they are ranked, so a key with many mentions is one row a value in its window.
    """
    seen = F.struct("paper_id", "ref_seq")
    counts = keyed_mentions(mentions).groupBy("key", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "first"))).filter(F.col("place") <= n)
    return ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("v")).select("key", F.transform("v", lambda x: F.concat_ws(":", x["value"], x["n"])).alias("values"))


def index_summary(index: DataFrame) -> DataFrame:
    """AG5: one row: mentions, keys, keys of several papers, keys by type."""
    return index.agg(F.sum("mention_count").alias("n_mentions"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("citing_paper_count") > 1).alias("n_repeated"), F.count_if(F.col("key_type") == "title").alias("n_titles"))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """DC10, WN8: (paper_id, status, first_difference) of two sources (paper_id, seq, raw) by their bare references.

    Sequences differ where one side has another reference or none; the two sides meet by place, not as whole lists.
    """
    side = lambda df, c: df.select("paper_id", F.row_number().over(Window.partitionBy("paper_id").orderBy("seq")).alias("pos"), t.loose(F.col("raw")).alias(c))
    met = side(left, "l").join(side(right, "r"), ["paper_id", "pos"], "full")
    differs = ~F.col("l").eqNullSafe(F.col("r"))
    rows = met.groupBy("paper_id").agg(F.count("l").alias("n_l"), F.count("r").alias("n_r"), F.min(F.when(differs, F.col("pos"))).alias("first_difference"))
    status = F.when(F.col("n_r") == 0, "missing_right").when(F.col("n_l") == 0, "missing_left").when(F.col("first_difference").isNull(), "match").otherwise("mismatch")
    return rows.select("paper_id", status.alias("status"), "first_difference")


#: Surnames of fewer letters are not met by likeness.
LEAST_LETTERS = 5


def cited_references(citations: DataFrame, references: DataFrame) -> DataFrame:
    """JN12: (citation, rung, n_refs, first_ref) of citations(citation, paper, surname, year) in references(ref, paper, surname, year).

    The first rung that finds anything decides: the same year with its suffix, then the same year without it. References are
    counted once for each paper, surname and year, and a citation of one row meets these counts; only citations of several rows meet
    the references themselves, as one of these may answer several rows.
    """
    base = lambda c: F.substring(c, 1, 4)
    several = citations.groupBy("citation").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("citation").alias("c"))
    same = F.col("citation").eqNullSafe(F.col("c"))

    named = references.select("ref", F.col("paper").alias("p"), F.col("surname").alias("s"), F.col("year").alias("y"), base(F.col("year")).alias("b")).filter("y is not null")
    tally = lambda *by: named.groupBy(*by).agg(F.countDistinct("ref").alias("n_refs"), F.min("ref").alias("first_ref"))
    exact = tally("p", "s", "y").select("p", "s", "y", F.struct(F.lit(1).alias("rung"), "n_refs", "first_ref").alias("one"))
    loose = tally("p", "s", "b").select("p", "s", "b", F.struct(F.lit(2).alias("rung"), "n_refs", "first_ref").alias("two"))
    single = citations.join(several, same, "left_anti")
    by_year = single.join(loose, (F.col("paper") == F.col("p")) & (F.col("surname") == F.col("s")) & (base(F.col("year")) == F.col("b"))).drop("p", "s", "b")
    by_year = by_year.join(exact, (F.col("paper") == F.col("p")) & (F.col("surname") == F.col("s")) & (F.col("year") == F.col("y")), "left")
    found = by_year.select("citation", F.coalesce("one", "two").alias("b")).select("citation", "b.*")

    rows = citations.join(several, same, "left_semi").distinct()
    met = rows.join(named, (F.col("paper") == F.col("p")) & (F.col("surname") == F.col("s")) & (base(F.col("year")) == F.col("b")))
    rung = F.when(F.col("year") == F.col("y"), 1).otherwise(2)
    best = met.groupBy("citation", rung.alias("rung")).agg(F.countDistinct("ref").alias("n_refs"), F.min("ref").alias("first_ref"))
    return found.unionByName(best.groupBy("citation").agg(F.min(F.struct("rung", "n_refs", "first_ref")).alias("b")).select("citation", "b.*"))


def alike_references(citations: DataFrame, references: DataFrame) -> DataFrame:
    """JN12, third rung: (citation, n_refs, first_ref, surnames) of citations that neither year finds: the references of their paper and year whose surname is alike.

    A surname of LEAST_LETTERS or more meets the three most alike surnames of a ratio of 0.9 or more; surnames lists them.
    """
    year = F.substring("year", 1, 4).alias("base")
    found = cited_references(citations, references).select("citation")
    left = citations.join(found, "citation", "left_anti").filter(F.char_length("surname") >= LEAST_LETTERS).select("citation", "paper", year, F.col("surname").alias("asked"))
    refs = references.select("ref", "paper", year, F.col("surname").alias("known"))
    close = closest_names(left, refs, ["paper", "base"])
    names = close.groupBy("paper", "base", "asked").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "known"))), lambda x: x["known"]), ",").alias("surnames"))
    held = close.join(refs, ["paper", "base", "known"]).groupBy("paper", "base", "asked").agg(F.countDistinct("ref").alias("n_refs"), F.min("ref").alias("first_ref"))
    return left.join(held, ["paper", "base", "asked"]).join(names, ["paper", "base", "asked"]).select("citation", "n_refs", "first_ref", "surnames")


def expanded_numbers(c: Column) -> Column:
    """JN13: the numbers of a citation such as `[1, 3-5]`; ranges wider than MOST_RANGE are not expanded."""
    parts = F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ",")

    def numbers(p: Column) -> Column:
        lo, hi = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(p, r"(\d+)$", 1).try_cast("int")
        return F.when((hi >= lo) & (hi - lo <= MOST_RANGE), F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(parts, numbers)))


def as_of(rows: DataFrame, key: str, order: list[str], mark: Column, value: Column) -> DataFrame:
    """JN14: rows with at, the value of the last marked row up to each, within its key; null before the first."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("at", F.last(F.when(mark, value), ignorenulls=True).over(upto))


def line_number(text: Column, offset: Column) -> Column:
    """JN15: the line, from 1, of a character offset, from 0."""
    before = F.substring(text, F.lit(1), offset)
    return F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def outside_earlier_spans(spans: DataFrame, key: str, start: str, end: str, order: str) -> DataFrame:
    """JN16: spans that do not start inside an earlier one of the same key: the latest end before decides, so no pairs are made."""
    before = Window.partitionBy(key).orderBy(start, order).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__reach", F.max(end).over(before)).filter(F.col("__reach").isNull() | (F.col("__reach") <= F.col(start))).drop("__reach")


def section_bounds(headings: DataFrame, key: str, pos: str, level: str) -> DataFrame:
    """JN17, WN7: headings with end_pos, the next heading of the same or a higher level, and parent_pos, the last of a higher level.

    One pass of windows for all levels there are; a document's headings are read once and no pair of them is formed.
    """
    levels = sorted(r[0] for r in headings.select(level).filter(F.col(level).isNotNull()).distinct().collect())  # a few, such as 1 to 6
    after = Window.partitionBy(key).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    nexts = [F.min(F.when(F.col(level) <= k, F.col(pos))).over(after) for k in levels]
    lasts = [F.max(F.when(F.col(level) < k, F.col(pos))).over(before) for k in levels]
    pick = lambda cols: F.coalesce(*[F.when(F.col(level) == k, c) for k, c in zip(levels, cols, strict=True)], F.lit(None).cast(headings.schema[pos].dataType))
    return headings.withColumns({"end_pos": pick(nexts), "parent_pos": pick(lasts)})


def containers(blocks: DataFrame, least: float = 0.9) -> DataFrame:
    """JN18: (doc, idx, parent) of the blocks that lie to `least` of their area in an image of their document.

    The largest share wins, then the smaller image, then the first; pairs stay within a document and its images.
    """
    box = ("x0", "y0", "x1", "y1")
    images = blocks.filter("type = 'image'").select(F.col("doc").alias("d"), F.col("idx").alias("parent"), *[F.col(c).alias(f"i_{c}") for c in box])
    inner, outer = tuple(F.col(c) for c in box), tuple(F.col(f"i_{c}") for c in box)
    met = blocks.join(images, (F.col("doc") == F.col("d")) & (F.col("idx") != F.col("parent")))
    share = F.round(t.box_overlap(inner, outer), 6)
    found = met.select("doc", "idx", "parent", share.alias("share"), F.round(t.box_area(*outer), 6).alias("area")).filter(F.col("share") >= least)
    return found.groupBy("doc", "idx").agg(F.min(F.struct((-F.col("share")).alias("s"), "area", "parent")).alias("b")).select("doc", "idx", "b.parent")


def merged_runs(blocks: DataFrame) -> DataFrame:
    """WN6: (doc, first_idx, last_idx, n) of blocks that continue the one before them."""
    order = Window.partitionBy("doc").orderBy("idx")
    runs = blocks.withColumn("run", F.sum(F.when(F.col("merge_prev"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("doc", "run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n")).drop("run")


def reference_lines(lines: Column) -> Column:
    """DC8: the lines after the first reference heading up to the next heading; none without such a heading."""
    starts = F.array_min(F.transform(lines, lambda x, i: F.when(t.is_reference_heading(x), i)))

    def after(start: Column) -> Column:  # start is bound once, not worked out again for every line
        rest = F.slice(lines, start + 2, F.greatest(F.size(lines), F.lit(1)))
        end = F.array_min(F.transform(rest, lambda x, i: F.when(x.rlike(r"^#{1,6} "), i)))
        return t.let(end, lambda n: F.slice(rest, 1, F.coalesce(n, F.size(rest))))

    return F.coalesce(t.let(starts, lambda s: F.when(s.isNotNull(), after(s))), F.array().cast("array<string>"))
