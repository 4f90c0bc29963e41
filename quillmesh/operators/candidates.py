"""Look-ups that answer from names, aliases or full text, candidate search by channels, record lint, and owners of captions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as t
from quillmesh.operators import retrieval as r
from quillmesh.operators.pages import VISUAL, owners

FIGURE_FIELDS = ("figure_id", "label", "caption")


def _fold(c: Column) -> Column:
    return F.lower(F.trim(c))


def exact_top(queries: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """RT4: (q, id, score), the n first exact hits of queries(q, text, wanted) in nodes(id, kind, name, aliases): names (2.0) before aliases (1.0), then by id.

    The n first of a form and kind are found once, so that a name of many owners is not paired with every query for it.
    """
    name = nodes.select("id", "kind", _fold(F.col("name")).alias("key"), F.lit(2.0).alias("score"))
    alias = nodes.select("id", "kind", F.explode("aliases").alias("alias")).select("id", "kind", _fold(F.col("alias")).alias("key"), F.lit(1.0).alias("score"))
    rows = queries.select("q", "wanted", _fold(F.col("text")).alias("key"))
    held = name.unionByName(alias).join(rows.select("key").distinct(), "key", "left_semi").groupBy("key", "id", "kind").agg(F.max("score").alias("score"))
    return r.dealt(rows, r.best_of(r.first_ids(held, ["key", "kind"], n, F.desc("score")), rows.select("key", "wanted").distinct(), n))


def find_exact(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """RT11: (q, id, hit) of queries(q, text) that equal, but for case and outer blanks, the name or an alias of nodes(id, name, aliases).

    hit is name, or the first such alias. Both comparisons are one equi-join on the folded form.
    """
    name = nodes.select("id", _fold(F.col("name")).alias("form"), F.lit(-1).alias("at"), F.lit("name").alias("hit"))
    alias = nodes.select("id", F.posexplode("aliases").alias("at", "alias")).select("id", _fold(F.col("alias")).alias("form"), "at", F.concat(F.lit("alias: "), "alias").alias("hit"))
    met = queries.select("q", _fold(F.col("text")).alias("form")).join(name.unionByName(alias), "form")
    return met.groupBy("q", "id").agg(F.min_by("hit", "at").alias("hit"))


def find_fulltext(queries: DataFrame, nodes: DataFrame, n: int = 5) -> DataFrame:
    """RT11: (q, id, score), the n best nodes by the words of their names and aliases; characters other than words have no meaning."""
    none = F.lit(None).cast("string")
    words = nodes.select("id", F.concat_ws(" ", "name", "aliases").alias("text"), none.alias("kind"))
    return r.bm25_top(queries.select("q", "text", none.alias("wanted")), words, n)


def lookup(queries: DataFrame, nodes: DataFrame, n: int = 5) -> DataFrame:
    """RT11: (q, id, match, hit) of each query's exact hits, all of them, and of the n best by full text where it has none."""
    exact = find_exact(queries, nodes)
    rest = queries.join(exact.select("q").distinct(), "q", "left_anti")
    full = find_fulltext(rest, nodes, n).select("q", "id", F.lit("fulltext").alias("match"), F.lit(None).cast("string").alias("hit"))
    return exact.select("q", "id", F.lit("exact").alias("match"), "hit").unionByName(full)


def lookup_context(found: DataFrame, links: DataFrame) -> DataFrame:
    """RT11: (q, id, paper): a row for each of links(title, type, role, dst) to a node that was found, titles cut to 24 characters as shown."""
    role = F.coalesce(F.concat(F.lit(" ("), "role", F.lit(")")), F.lit(""))
    shown = links.select(F.col("dst").alias("id"), F.concat(F.substring("title", 1, 24), F.lit(" "), "type", role).alias("paper"))
    return found.select("q", "id").join(shown, "id").select("q", "id", "paper")


def recall_channels(queries: DataFrame, nodes: DataFrame, pool: int = r.POOL) -> DataFrame:
    """RT4, RT6: (q, channel, id, score) of queries(q, mention, description, kind) over nodes(id, kind, name, aliases, description).

    identifier: exact names and aliases, in the order of their hits; lexical_name and lexical_text: the `pool` best of the
    kind by mention and by description. A null kind admits every node; a missing text disables its channel (RT12).
    """
    mention = queries.filter("mention is not null").select("q", F.col("mention").alias("text"), F.col("kind").alias("wanted"))
    described = queries.filter("description is not null").select("q", F.col("description").alias("text"), F.col("kind").alias("wanted"))
    names = nodes.select("id", F.explode(F.concat(F.array("name"), "aliases")).alias("raw"), "kind")
    texts = nodes.select("id", F.col("description").alias("text"), "kind")
    channels = {"identifier": exact_top(mention, nodes, pool), "lexical_name": r.lexical_top(mention, names, pool), "lexical_text": r.bm25_top(described, texts, pool)}
    return reduce(DataFrame.unionByName, [c.select("q", F.lit(name).alias("channel"), "id", "score") for name, c in channels.items()])


def channel_status(queries: DataFrame, channels: DataFrame) -> DataFrame:
    """RT4: (q, channel, status): disabled where the channel's text is missing, else ok(number of candidates)."""
    needs = {"identifier": "mention", "lexical_name": "mention", "lexical_text": "description"}
    each = queries.select("q", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(t).isNotNull().alias("on")) for c, t in needs.items()])).alias("x")).select("q", "x.*")
    n = channels.groupBy("q", "channel").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("on"), F.concat(F.lit("ok("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")"))).otherwise("disabled")
    return each.join(n, ["q", "channel"], "left").select("q", "channel", status.alias("status"))


def find_entities(channels: DataFrame, n: int = r.TOP_N) -> DataFrame:
    """RT6, RT12: (q, id, place, pinned) of channels as recall_channels gives them: exact hits come first, unscored; the others by reciprocal ranks."""
    exact = channels.filter("channel = 'identifier'")
    pinned = exact.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).select("q", "id", "at")
    return r.fuse_pinned(pinned, channels.filter("channel <> 'identifier'"), n=n).select("q", "id", "place", "pinned")


def lint_records(records: DataFrame, key: str, claim_types: list[str], figure_statuses: list[str], run_statuses: list[str]) -> DataFrame:
    """PF8: (key, path, problem) of records(key, claims, cites, figures, experiments), arrays of structs.

    claims(claim_type, evidence): at most two, without evidence, of a known type; cites(local_claim_id): bound to no claim;
    figures(figure_id, label, caption, status) and experiments(status): fields present and statuses known. Null is missing.
    """

    def each(column: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
        items = records.select(key, F.posexplode(column).alias("i", "x"))
        place = lambda leaf: F.concat(F.lit(f"{column}["), F.col("i").cast("string"), F.lit(f"].{leaf}"))
        found = F.array_compact(F.array(*[F.when(c, F.struct(place(leaf).alias("path"), F.lit(p).alias("problem"))) for leaf, c, p in rules]))
        return items.select(key, F.explode(found).alias("f")).select(key, "f.*")

    unknown = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    many = records.filter(F.size("claims") > 2).select(key, F.lit("claims").alias("path"), F.lit("too-many").alias("problem"))
    parts = [
        each("claims", [("evidence", F.col("x.evidence").isNotNull(), "not-allowed"), ("claim_type", unknown("x.claim_type", claim_types), "unknown")]),
        each("cites", [("local_claim_id", F.col("x.local_claim_id").isNotNull(), "not-allowed")]),
        each("figures", [*[(f, F.col(f"x.{f}").isNull(), "missing") for f in FIGURE_FIELDS], ("status", unknown("x.status", figure_statuses), "unknown")]),
        each("experiments", [("status", unknown("x.status", run_statuses), "unknown")]),
    ]
    return reduce(DataFrame.unionByName, parts, many)


def visual_parents(blocks: DataFrame) -> DataFrame:
    """JN19: (doc, idx, parent) of every caption and footnote among blocks(doc, idx, type, x0, y0, x1, y1), as pages.owners finds it; parent is null where none is next to it."""
    kind = F.when(F.col("type").isin("caption", "footnote"), F.col("type")).when(F.col("type").isin(*VISUAL), "visual").otherwise("flow")
    return owners(blocks.withColumn("kind", kind), ["doc"], t.box_midpoint_distance).filter(F.col("type").isin("caption", "footnote")).select("doc", "idx", "parent")
