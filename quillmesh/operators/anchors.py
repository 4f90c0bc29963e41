"""Anchors into sections of papers, rules of records by rule tables, and contexts around citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as t

ANCHOR = r"^([^#\s]+)#([^:\s]+):(\d+)-(\d+)$"


def parsed_anchor(anchor: Column) -> Column:
    """AC11: (paper, section, first, last) of an anchor paper#section:first-last, null if it has another form."""
    part = lambda i: F.regexp_extract(anchor, ANCHOR, i)
    return F.when(anchor.rlike(ANCHOR), F.struct(part(1).alias("paper"), part(2).alias("section"), part(3).cast("long").alias("first"), part(4).cast("long").alias("last")))


def read_lines(text: Column, first: Column, last: Column) -> Column:
    """AC10: the lines first to last of a text, counted from 1."""
    return F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def anchor_issues(anchors: DataFrame, sections: DataFrame) -> DataFrame:
    """PF5: anchors(anchor) with issue: its form, its paper, its section or its lines; null if it is sound. sections(paper, section, first, last)."""
    a = anchors.withColumn("p", parsed_anchor(F.col("anchor")))
    papers = sections.select(F.col("paper").alias("has_paper")).distinct()
    own = sections.select(F.col("paper").alias("s_paper"), F.col("section").alias("s_section"), F.col("first").alias("s_first"), F.col("last").alias("s_last"))
    met = a.join(papers, F.col("p.paper") == F.col("has_paper"), "left").join(own, (F.col("p.paper") == F.col("s_paper")) & (F.col("p.section") == F.col("s_section")), "left")
    inside = (F.col("s_first") <= F.col("p.first")) & (F.col("p.first") <= F.col("p.last")) & (F.col("p.last") <= F.col("s_last"))
    issue = F.when(F.col("p").isNull(), "form").when(F.col("has_paper").isNull(), "paper").when(F.col("s_section").isNull(), "section").when(~inside, "lines")
    return met.select(*anchors.columns, issue.alias("issue"))


def _broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))).alias("rule"))


def node_violations(nodes: DataFrame, rules: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """PF3: (ref, rule) of nodes(ref, label, props map) against rules label -> (required, further) properties."""
    names = F.map_keys(F.map_filter("props", lambda k, v: v.isNotNull()))
    of = lambda pick: reduce(lambda w, l: w.when(F.col("label") == l, F.array(*[F.lit(x) for x in pick(rules[l])]).cast("array<string>")), rules, F.when(F.lit(False), F.array().cast("array<string>")))  # noqa: E731, E741
    known = F.col("label").isin(*rules)
    return _broken(nodes, "ref", {
        "unknown-label": ~F.coalesce(known, F.lit(False)),
        "missing-property": known & (F.size(F.array_except(of(lambda r: r[0]), names)) > 0),
        "unknown-property": known & (F.size(F.array_except(F.map_keys("props"), of(lambda r: r[0] + r[1]))) > 0),
    })


def rel_violations(rels: DataFrame, ends: list[tuple[str, str, str]], roles: dict[str, list[str]]) -> DataFrame:
    """PF4: (ref, rule) of rels(ref, type, src, dst, role): its type, the labels of its ends, and the role that its type asks for."""
    known = F.col("type").isin(*{e[0] for e in ends})
    fits = reduce(lambda w, e: w | ((F.col("type") == e[0]) & (F.col("src") == e[1]) & (F.col("dst") == e[2])), ends, F.lit(False))
    needs = F.col("type").isin(*roles)
    right = reduce(lambda w, k: w | ((F.col("type") == k) & F.col("role").isin(*roles[k])), roles, F.lit(False))
    return _broken(rels, "ref", {
        "unknown-type": ~known,
        "ends-not-allowed": known & ~fits,
        "role-missing": needs & F.col("role").isNull(),
        "role-unknown": needs & F.col("role").isNotNull() & ~F.coalesce(right, F.lit(False)),
        "role-not-asked": known & ~needs & F.col("role").isNotNull(),
    })


def resource_issues(records: DataFrame, kinds: list[str], relations: list[str]) -> DataFrame:
    """PF6: (id, rule) of records(id, kind, relation, evidence): the form kind::slug, repeated ids, enums, and evidence of all but mentions."""
    single = _broken(records, "id", {
        "form": ~F.col("id").rlike("^[a-z]+::[a-z0-9]+(?:-[a-z0-9]+)*$"),
        "kind": ~F.col("kind").isin(*kinds),
        "relation": ~F.col("relation").isin(*relations),
        "evidence-missing": (F.col("relation") != "mentions") & (F.coalesce("evidence", F.lit("")) == ""),
    })
    twice = records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated").alias("rule"))
    return single.unionByName(twice).distinct()


def normalized_resource(kind: Column, name: Column, url: Column, kinds: list[str]) -> Column:
    """PF11: (kind, id, url): an unknown kind is other, the id is kind::slug, the URL is in normal form."""
    known = F.when(kind.isin(*kinds), kind).otherwise("other")
    return F.struct(known.alias("kind"), F.concat_ws("::", known, t.slug(name)).alias("id"), t.normalize_url(url).alias("url"))


def sentence_at(paragraph: Column, start: Column, end: Column, more: int = 240) -> Column:
    """ST15: the sentence in which the span start to end (from 0) begins, with up to `more` characters after a span that leaves it."""
    n = F.char_length(paragraph)

    def step(acc: Column, piece: Column) -> Column:
        stop = acc["at"] + F.char_length(piece)
        hit = (acc["at"] <= start) & (start < stop)
        return F.struct(stop.alias("at"), F.when(hit, acc["at"]).otherwise(acc["a"]).alias("a"), F.when(hit, stop).otherwise(acc["b"]).alias("b"))

    def of(pieces: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
        return F.aggregate(pieces, none, step, lambda acc: F.struct(F.coalesce(acc["a"], F.lit(0)).alias("a"), F.coalesce(acc["b"], n).alias("b")))

    pieces = F.split(F.regexp_replace(paragraph, r"((?<=[.!?])\s+)(?=[A-Z0-9#])", "$1\u0001"), "\u0001")
    span = t.let(of(pieces), lambda s: F.struct(s["a"].alias("a"), F.when(end > s["b"], F.least(n, end + more)).otherwise(s["b"]).alias("b")))
    return t.let(span, lambda s: t.squeeze(F.substring(paragraph, s["a"] + 1, s["b"] - s["a"])))


def plain_contexts(docs: DataFrame, key: str, text: str, pattern: str, least: int = 40, most: int = 100) -> DataFrame:
    """ST32: (key, n, context): the first `most` paragraphs of at least `least` characters in which the pattern occurs."""
    found = docs.select(key, F.posexplode(F.split(text, "\n\n")).alias("pos", "context")).filter((F.char_length("context") >= least) & F.col("context").rlike(pattern))
    return found.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos")).cast("long")).filter(F.col("n") <= most).select(key, "n", "context")


def indentation(lines: DataFrame, key: str, line: str) -> DataFrame:
    """WN13: lines with level: their leading blanks in units of the least of their text, halves to the even level."""
    width = F.char_length(F.regexp_extract(line, "^( *)", 1))
    unit = F.min(F.when(width > 0, width)).over(Window.partitionBy(key))
    return lines.withColumn("level", F.coalesce(F.bround(width / unit), F.lit(0.0)).cast("long"))


def discovered(paths: DataFrame, path: str, wanted: list[str] | None = None) -> DataFrame:
    """SC5: (paper, top, year, kind, path) of paths top/year/kind/paper.pdf; the PDF of a whole volume, whose name has no number, is left out."""
    parts = F.split(path, "/")
    paper = F.regexp_replace(F.element_at(parts, -1), r"\.pdf$", "")
    rows = paths.filter(F.col(path).rlike(r"^[^/]+/\d{4}/[^/]+/[^/]+\.\d+\.pdf$")).select(paper.alias("paper"), F.get(parts, 0).alias("top"), F.get(parts, 1).alias("year"), F.get(parts, 2).alias("kind"), F.col(path).alias("path"))
    return rows if wanted is None else rows.filter(F.col("paper").isin(*wanted))
