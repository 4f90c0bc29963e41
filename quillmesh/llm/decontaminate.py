"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions throughout.

An item is cut into windows of `window` words (a shorter item is one window), a window into shingles of up to `shingle`
words. A window can only stand in a document that has all its shingles, so by the prefix principle its rarest one decides
whether the pair is looked at. One pass counts the windows' shingles over the whole corpus, which gives the order of
rarity; a second one joins the documents' shingles to the prefixes alone. A match fixes where its window would start;
windows that would begin before the document or end after it are dropped by length and position, and the rest are
compared word by word in the documents that have candidates.

Rows that cross a shuffle are (document, place, hash) or (hash), and the texts of documents with candidates, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import alnum_words, gram_at, join_rows, materialize, rows_of, small_side, wrapped

#: Tables of hashes up to so many rows, some 40 bytes each, are broadcast; larger ones shuffle.
BROADCAST_ROWS = 1_000_000


def item_windows(benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(item_id, words, size): the windows of all items."""
    words = alnum_words(F.col("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s + 1, F.lit(window)))).alias("words")).withColumn("size", F.size("words"))


def window_grams(windows: DataFrame, shingle: int) -> tuple[DataFrame, list[int]]:
    """(win, size, offset, gram) of every shingle of windows(win, words, size), and the sizes that shingles have."""
    sizes = [r[0] for r in windows.select(F.least("size", F.lit(shingle)).alias("k")).distinct().orderBy("k").collect()] or [shingle]  # at most `shingle` values
    grams = None
    for k in sizes:
        of_k = windows.filter(F.least("size", F.lit(shingle)) == k).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
        each = of_k.select("win", "size", F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - k), lambda o: F.struct(o.alias("offset"), gram_at("h", o, k).alias("gram")))).alias("g")).select("win", "size", "g.*")
        grams = each if grams is None else grams.union(each)
    return grams, sizes


def placed_grams(sizes: list[int]) -> Column:
    """An array of (pos, gram), all shingles of the array h of word hashes, for each of the sizes."""
    none = F.array().cast("array<struct<pos:int,gram:bigint>>")

    def of(k: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("h") - k, F.lit(0)))
        return F.when(F.size("h") >= k, F.transform(starts, lambda i: F.struct(i.alias("pos"), gram_at("h", i, k).alias("gram")))).otherwise(none)

    return F.concat(*[of(k) for k in sizes])


def hashed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, __k, n_words, h): the hashes of the words of each text, in order."""
    rows = rows_of(docs, "text").select("doc_id", "__k", F.transform(alnum_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    return rows.withColumn("n_words", F.size("h").cast("long"))


def candidates(docs: DataFrame, windows: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Places where a window's rarest shingle stands and its other words would fit, (doc_id, __k, start, win, size), and the rows of docs, (doc_id, __k, n_words)."""
    grams, sizes = window_grams(windows, shingle)
    grams = materialize(grams, "grams")
    rows = hashed_words(docs)
    wanted = small_side(materialize(grams.select("gram").distinct(), "wanted"), BROADCAST_ROWS)
    counts = rows.select(F.explode(F.transform(placed_grams(sizes), lambda g: g["gram"])).alias("gram")).join(wanted, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "gram")
    prefix = grams.join(counts, "gram", "left").groupBy("win", "size").agg(F.min(rarity).alias("r")).filter("r.n > 0").select("win", "size", "r.offset", "r.gram")
    prefix = materialize(prefix, "prefixes")
    first = small_side(prefix.select("gram", F.lit(True).alias("known")).distinct(), BROADCAST_ROWS)
    head = F.coalesce((F.col("pos") == 0) & (F.col("gram") == F.col("head")), F.lit(True))  # one row of each document stays, whatever matches
    placed = rows.withColumn("head", gram_at("h", F.lit(0), sizes[0])).select("doc_id", "__k", "n_words", "head", F.inline_outer(placed_grams(sizes)))
    matched = materialize(placed.join(first, "gram", "left").withColumn("head", head).filter("known or head"), "matches")
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    found = matched.filter("known").join(small_side(prefix, BROADCAST_ROWS), "gram").filter(inside).select("doc_id", "__k", start.alias("start"), "win", "size")
    return found, matched.filter("head").select("doc_id", "__k", "n_words")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where windows stand, (doc_id, __k, start, win, size), the rows of docs, (doc_id, __k, n_words), and the items of each window, (item_id, win).

    Every place is verified word by word: the candidates of a document meet its text once.
    """
    win = F.sha2(F.concat_ws(" ", "words"), 256).alias("win")  # words have no blanks, so equal digests mean equal words
    named = materialize(item_windows(benchmark, window).select("item_id", win, "words", "size"), "windows")
    windows = materialize(named.select("win", "words", "size").distinct(), "distinct-windows")
    found, rows = candidates(docs, windows, shingle)
    found = found.distinct().join(small_side(windows.select("win", "words"), BROADCAST_ROWS // 10), "win")
    lists = materialize(found.groupBy("doc_id", "__k").agg(F.collect_set(F.struct("start", "size", "win", "words")).alias("list")), "candidates")
    keys = small_side(lists.select("doc_id", "__k"), BROADCAST_ROWS)
    texts = join_rows(rows_of(docs, "text").select("doc_id", "__k", "text"), keys, "left_semi")
    both = join_rows(texts, lists, "inner").select("doc_id", "__k", alnum_words(F.col("text")).alias("all"), "list")
    true = F.filter("list", lambda c: F.slice("all", c["start"] + 1, c["size"]) == c["words"])
    at = both.select("doc_id", "__k", F.explode(true).alias("c")).select("doc_id", "__k", "c.start", "c.win", "c.size").distinct()
    return at, rows, named.select("item_id", "win")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, share: int = 20) -> DataFrame:
    """doc_id, __k, n_words, n_hit, n_items, items (sorted ids, comma-joined) and contaminated, for every row of docs.

    Words are A-Z lower-cased runs of letters, digits and non-ASCII characters. A word of the document inside any
    occurrence of a window is hit; a document is contaminated if hits are at least 1 / share of its words. Null and empty
    texts have no words and no hits, long ones are searched whole; items without words have no window; items without an id
    hit words but are not counted among the items; ids that repeat count once, ties of rarity go to the first place. Rows
    repeated exactly get equal results. Either table may be empty; columns besides those named are ignored, whatever their
    names.
    """
    at, rows, named = occurrences(docs, benchmark, window, shingle)
    at = materialize(at, "occurrences")
    by_start = Window.partitionBy("doc_id", "__k").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    reached = F.coalesce(F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = at.select("doc_id", "__k", "start", "size").distinct()
    hits = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", reached))).groupBy("doc_id", "__k").agg(F.sum("new").alias("n_hit"))
    named = materialize(named.filter("item_id is not null").distinct(), "items")
    items = at.select("doc_id", "__k", "win").distinct().join(small_side(named, BROADCAST_ROWS), "win").groupBy("doc_id", "__k").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    joined = join_rows(join_rows(rows, hits, "left"), items, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "__k", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids, ",").alias("items"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names.

    Null and empty texts stay, as do all rows where either table is empty; rows repeated exactly fare alike.
    """
    bad = contamination(docs, benchmark).filter("contaminated").select("doc_id", "__k").distinct()
    return join_rows(wrapped(docs), small_side(materialize(bad, "contaminated"), BROADCAST_ROWS), "left_anti").select("row.*")
