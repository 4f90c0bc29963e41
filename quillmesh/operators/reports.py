"""Reports, rules and merges over records: counts by state, coverage, tolerance, matching by several keys, defaults and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as t


def batch_summary(tasks: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """AG10: (status, n) of tasks(key) under states(key, status); tasks without a state are pending."""
    return tasks.join(states, key, "left").groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def throughput(log: DataFrame, key: str, at: str) -> DataFrame:
    """AG11: one row with the seconds between the first and last entry, the number of keys, and keys an hour to one place."""
    found = log.agg((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))).alias("us"), F.countDistinct(key).alias("n"))
    return found.select((F.col("us") / 1e6).alias("elapsed"), "n", F.round(F.col("n") * 3.6e9 / F.col("us"), 1).alias("per_hour"))


def field_coverage(rows: DataFrame, key: str, shares: dict[str, Column], counts: dict[str, Column]) -> DataFrame:
    """AG14: for each key its rows, the percentage with each of `shares` filled, and how many have each of `counts`."""
    n = F.count(F.lit(1))
    filled = lambda c: F.count_if(F.coalesce(c, F.lit("")) != "")
    return rows.groupBy(key).agg(n.alias("total"), *[(filled(c) / n * 100).alias(name) for name, c in shares.items()], *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items()])


def beyond_tolerance(actual: Column, expected: Column, share: float = 0.15, least: int = 3) -> Column:
    """AG15: whether two counts differ by more than `least` and a share of the larger; never where nothing was expected."""
    allowed = F.greatest(F.lit(least), F.floor(F.greatest(actual, expected) * share))
    return F.coalesce((expected > 0) & (F.abs(actual - expected) > allowed), F.lit(False))


def reference_totals(rows: DataFrame, key: str, ref: str, at: str, expected: str) -> DataFrame:
    """AG20: rows, known, unknown and repeated references of each key, first and last time, and whether the rows are as many as expected."""
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(
        n.alias("n_rows"),
        F.countDistinct(ref).alias("n_known"),
        F.count_if(F.col(ref).isNull()).alias("n_null"),
        (F.count(ref) - F.countDistinct(ref)).alias("n_repeated"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        (n == F.max(expected)).alias("count_matches"),
    )


def success_report(rows: DataFrame, key: str, ok: Column) -> DataFrame:
    """AG26: total, succeeded, failed and whether all are well, for each key; an unknown outcome is a failure."""
    good = F.coalesce(ok, F.lit(False))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.every(good).alias("all_ok"))


def contexts_of_references(contexts: DataFrame, paper: str, ref: str, order: str) -> DataFrame:
    """AG9: for each reference of a paper its citations and their ids in order."""
    return contexts.filter(F.col(ref).isNotNull()).groupBy(paper, ref).agg(F.count(F.lit(1)).alias("citation_count"), F.array_sort(F.collect_list(order)).alias("context_ids"))


def context_totals(contexts: DataFrame, paper: str, ref: str) -> DataFrame:
    """AG8: one row with contexts, matched and unresolved ones, and papers that have any."""
    return contexts.agg(F.count(F.lit(1)).alias("contexts"), F.count(ref).alias("matched"), F.count_if(F.col(ref).isNull()).alias("unresolved"), F.countDistinct(paper).alias("papers"))


def citing_sets(mentions: DataFrame, key: Column, paper: str) -> DataFrame:
    """AG4: for each key its mentions, distinct citing papers and their sorted ids."""
    return mentions.withColumn("key", key).filter("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("mention_count"), F.countDistinct(paper).alias("citing_paper_count"), F.array_sort(F.collect_set(paper)).alias("citing_paper_ids"))


def first_matching_key(incoming: DataFrame, known: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """JN10: incoming with `match` and `matched_by`: the known row of the first key that has one; of several the least id."""
    out = incoming
    for i, k in enumerate(keys):
        of = known.filter(F.col(k).isNotNull()).groupBy(F.col(k)).agg(F.min(id_).alias(f"__m{i}"))
        out = out.join(of, k, "left")
    found = [F.col(f"__m{i}") for i in range(len(keys))]
    by = F.coalesce(*[F.when(m.isNotNull(), F.lit(k)) for k, m in zip(keys, found, strict=True)])
    return out.select(*incoming.columns, F.coalesce(*found).alias("match"), by.alias("matched_by"))


def compared_by_name(old: DataFrame, new: DataFrame, paper: str, name: str, order: str) -> DataFrame:
    """JN20: (paper, key, status) of names compared loosely: matched, missing or extra; of names of one key the last counts."""
    last = lambda df, side: df.withColumn("key", t.loose(F.col(name))).filter("key <> ''").groupBy(paper, "key").agg(F.max(F.struct(order, name)).alias(side))
    both = last(old, "o").join(last(new, "n"), [paper, "key"], "full")
    return both.select(paper, "key", F.col("o")[name].alias("old_name"), F.col("n")[name].alias("new_name"), F.when(F.col("n").isNull(), "missing").when(F.col("o").isNull(), "extra").otherwise("matched").alias("status"))


def rescued(missing: DataFrame, new: DataFrame, paper: str, key: str, least: int = 4) -> DataFrame:
    """JN21: missing rows with a partner in the same paper whose key holds theirs or lies in it, if both have `least` characters."""
    long = lambda df: df.filter(F.char_length(key) >= least)
    partner = long(new).select(paper, F.col(key).alias("partner"))
    met = long(missing).join(partner, paper).filter(F.contains("partner", key) | F.contains(key, "partner"))
    return met.groupBy(paper, key).agg(F.min("partner").alias("partner"))


def with_resolution(rows: DataFrame, resolutions: DataFrame, url: str, canonical: str, availability: str) -> DataFrame:
    """JN22: rows with the status of their URL or else of its canonical form; what was available and is resolved as missing is missing."""
    of = resolutions.groupBy("url").agg(F.max("status").alias("status"))
    a, b = of.select(F.col("url").alias(url), F.col("status").alias("__a")), of.select(F.col("url").alias(canonical), F.col("status").alias("__b"))
    out = rows.join(a, url, "left").join(b, canonical, "left").withColumn("resolution", F.coalesce("__a", "__b"))
    return out.withColumn(availability, F.when((F.col(availability) == "available") & (F.col("resolution") == "missing"), "missing").otherwise(F.col(availability))).select(*rows.columns, "resolution")


def titles_at(titles: Column, places: Column) -> Column:
    """JN23: the titles at places, counted from 1, in their order; empty where there is none."""
    return F.transform(places, lambda p: F.coalesce(F.get(titles, p - 1), F.lit("")))


def with_actual(rows: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """JN25: rows with the value of actual where it differs, and whether it was changed."""
    new = actual.select(*keys, F.col(value).alias("__new"))
    differs = F.coalesce(F.col("__new") != F.col(value), F.col("__new").isNotNull())
    return rows.join(new, keys, "left").withColumn("changed", differs).withColumn(value, F.coalesce("__new", value)).drop("__new")


def filled_from(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JN28: rows whose missing columns are filled from other by key."""
    more = other.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(more, key, "left").withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def front_matter(paper_id: Column, warnings: Column) -> Column:
    """PF9: whether a record is front matter: a warning says so, or its id does not end in a number after the last point."""
    said = F.lower(F.array_join(F.coalesce(warnings, F.array().cast("array<string>")), " "))
    return F.contains(said, F.lit("front-matter")) | F.contains(said, F.lit("front matter")) | F.contains(said, F.lit("not a research paper")) | ~F.substring_index(F.coalesce(paper_id, F.lit("")), ".", -1).rlike(r"^\d+$")


def merged_fields(base: Column, update: Column, allowed: list[str]) -> Column:
    """PF10, MP1: the map base with the values of update that are allowed and known."""
    new = F.map_filter(update, lambda k, v: k.isin(*allowed) & v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def chain_breaks(pages: DataFrame, key: str, offset: str, size: str) -> DataFrame:
    """PF12: pages whose end is not where the next page of the key begins; the last one has no next."""
    return pages.withColumn("next", F.lead(offset).over(Window.partitionBy(key).orderBy(offset))).filter(F.col("next") != F.col(offset) + F.col(size))


def renumbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """PF13, WN4: rows numbered from 1 in order within their key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def kept_citation(raw: Column, matched: Column, unresolved: Column, most: int = 500) -> Column:
    """PF14: citations that are matched, or unresolved and not longer than `most`."""
    return F.coalesce(F.size(matched) > 0, F.lit(False)) | (F.coalesce(F.size(unresolved) > 0, F.lit(False)) & (F.char_length(raw) <= most))


def quality_ok(papers: DataFrame, merge: DataFrame, quality: DataFrame, run: DataFrame, key: str) -> DataFrame:
    """PF18: papers with ok: the merge did not fail, the quality report says ok, and the run went beyond preparation; a missing merge report is no fault."""
    state = lambda df, name: df.select(key, F.lower(F.col("status")).alias(name))
    all_ = papers.join(state(merge, "m"), key, "left").join(quality.select(key, "ok").withColumnRenamed("ok", "q"), key, "left").join(state(run, "r"), key, "left")
    ok = (F.coalesce("m", F.lit("")) != "failed") & F.coalesce("q", F.lit(False)) & ~F.coalesce("r", F.lit("")).isin("", "prepared")
    return all_.select(key, ok.alias("ok"), (F.col("q").isNotNull() & ~ok).alias("failed"))


def filtered_sections(sections: DataFrame, key: str, pos: str, end: str, chosen: Column, include: bool) -> DataFrame:
    """PF15: sections by title, over the bounds of section_bounds: without the chosen ones and all below, or only these and what is above them.

    A section lies below a chosen one if that one's end is beyond it, and above one if the next chosen place is before its end.
    """
    last = F.lit((1 << 62) - 1)
    stop = F.coalesce(F.col(end), last)
    by = Window.partitionBy(key).orderBy(pos)
    below = F.coalesce(F.max(F.when(chosen, stop)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > F.col(pos), F.lit(False))
    above = F.coalesce(F.min(F.when(chosen, F.col(pos))).over(by.rowsBetween(1, Window.unboundedFollowing)) < stop, F.lit(False))
    return sections.withColumns({"__below": below, "__above": above}).filter((F.col("__below") | F.col("__above")) if include else ~F.col("__below")).drop("__below", "__above")


def kind_filter(rows: DataFrame, column: str, wanted: str | None) -> DataFrame:
    """PF1: rows of the wanted label, or all where none is wanted."""
    return rows if wanted is None else rows.filter(F.col(column) == wanted)


def overfetched(scored: DataFrame, keep: Column, pool: int, factor: int = 5) -> DataFrame:
    """TK3: of the best pool * factor rows of each query those to keep, and of these the best `pool`."""
    by = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    wide = scored.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= pool * factor).filter(keep)
    return wide.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= pool).drop("__n")


def task_priority(state: Column, force: bool = False) -> Column:
    """TK5: 0 for failed and running tasks, 1 for pending ones, 2 (99 unless forced) for done ones, 3 for others."""
    return F.when(state.isin("failed", "running"), 0).when(state.isNull() | (state == "pending"), 1).when(state == "done", 2 if force else 99).otherwise(3)


def key_rank(kind: Column) -> Column:
    """TK6: title, doi, arxiv, url, raw."""
    return F.array_position(F.array(*[F.lit(k) for k in ("title", "doi", "arxiv", "url", "raw")]), kind)


def capped_contexts(rows: DataFrame, key: str, order: list[str], text: str, most: int = 200, chars: int = 700) -> DataFrame:
    """TK7: the first `most` contexts of each key, each cut to `chars` characters, for a prompt of bounded size."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("n", n.cast("long")).filter(F.col("n") <= most).withColumn(text, F.substring(text, 1, chars))


def appended(base: Column, more: Column) -> Column:
    """SO6: base followed by the values of more that it lacks, each once."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(base, none), F.array_except(F.coalesce(more, none), F.coalesce(base, none)))


def semantic_update(base: Column, update: Column, allowed: list[str]) -> tuple[Column, Column]:
    """JN26: base with the allowed fields of update, and the sorted names of the fields of update that were rejected."""
    return merged_fields(base, update, allowed), F.array_sort(F.filter(F.map_keys(update), lambda k: ~k.isin(*allowed)))


def resolved_assets(wanted: DataFrame, files: DataFrame, folders: list[str], endings: list[str]) -> DataFrame:
    """JN24: wanted(paper, name) with path: the first of folders x endings that exists among files(paper, path), else the only file of that base name."""
    tried = F.array(*[F.struct(F.lit(i).alias("place"), F.concat(F.lit(f), "name", F.lit(e)).alias("path")) for i, (f, e) in enumerate((f, e) for f in folders for e in endings)])
    direct = wanted.select("paper", "name", F.explode(tried).alias("t")).select("paper", "name", "t.*").join(files.select("paper", "path"), ["paper", "path"]).groupBy("paper", "name").agg(F.min(F.struct("place", "path")).alias("d"))
    base = files.groupBy("paper", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only")).filter("n = 1")
    return wanted.join(direct, ["paper", "name"], "left").join(base, ["paper", "name"], "left").select("paper", "name", F.coalesce("d.path", "only").alias("path"))


def resolved_entries(entries: DataFrame, known: DataFrame) -> DataFrame:
    """JN29: (entry, id, by): by s2, else arxiv, else doi, else a title that is equal loosely; a title found under other words is a mismatch."""
    out = entries
    for k in ("s2", "arxiv", "doi"):
        out = out.join(known.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias(f"by_{k}")), k, "left")
    titles = known.select(t.loose(F.col("title")).alias("loose"), "id").filter("loose <> ''").groupBy("loose").agg(F.min("id").alias("by_title"))
    out = out.withColumn("loose", t.loose(F.col("title"))).join(titles, "loose", "left")
    found = [F.col(f"by_{k}") for k in ("s2", "arxiv", "doi", "title")]
    by = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for c, k in zip(found, ("s2", "arxiv", "doi", "title"), strict=True)], F.lit("mismatch"))
    return out.select("entry", F.coalesce(*found).alias("id"), by.alias("by"))


def selected_sources(bindings: DataFrame, budget: int) -> DataFrame:
    """AC9: each (material, version, location) of a request once with all its targets, in order of priority, selected while the running size stays within the budget."""
    once = bindings.groupBy("request", "material", "version", "location").agg(F.min("priority").alias("priority"), F.max("size").alias("size"), F.array_sort(F.collect_set("target")).alias("targets"))
    upto = Window.partitionBy("request").orderBy("priority", "material", "version", "location").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return once.withColumn("state", F.when(F.sum("size").over(upto) <= budget, "selected").otherwise("over-budget"))


def interleaved(segments: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """WN11: the segments of each key joined in the order of their blocks."""
    return segments.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("caption"))


def numbered_block(items: Column, most: int, chars: int) -> Column:
    """ST39: the first `most` items as numbered lines of a prompt, each cut to `chars` characters."""
    return F.array_join(F.transform(F.slice(items, 1, most), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(x, 1, chars))), "\n")


def repaired_references(candidates: Column) -> Column:
    """WN5: (entries, joined): lines of a list of references folded into entries.

    A new entry begins where what is gathered looks complete and the line looks like a start; other lines are joined to it,
    which counts if it looked incomplete. Entries that repeat stay at their first place.
    """
    lines = F.filter(F.transform(candidates, t.plain_text), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("entries"), F.lit("").alias("current"), F.lit(0).alias("joined"))

    def step(acc: Column, line: Column) -> Column:
        done, first = t.looks_complete(acc["current"]), acc["current"] == ""
        fresh = done & (t.looks_like_start(line) | t.looks_like_authors(line)) & ~first
        return F.struct(
            F.when(fresh, F.array_append(acc["entries"], F.trim(acc["current"]))).otherwise(acc["entries"]).alias("entries"),
            F.when(fresh | first, line).otherwise(t.join_fragments(acc["current"], line)).alias("current"),
            (acc["joined"] + F.when(~first & ~fresh & ~done, 1).otherwise(0)).alias("joined"),
        )

    def end(acc: Column) -> Column:
        whole = F.when(acc["current"] != "", F.array_append(acc["entries"], F.trim(acc["current"]))).otherwise(acc["entries"])
        return F.struct(F.array_distinct(whole).alias("entries"), acc["joined"].alias("joined"))

    return F.aggregate(lines, empty, step, end)
