"""TeX packages end to end: main file, inlined source, paper records; lists of content blocks and the references read from them."""

from __future__ import annotations

import re
from posixpath import basename, dirname

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import tex
from quillmesh.functions.text import by_row
from quillmesh.operators.papers import package_references

# What speaks for and against a file as the main one.
MARKERS = {"\\documentclass": 100, "\\begin{document}": 60, "\\title": 20, "\\maketitle": 10}
BASENAMES = {"main.tex": 15, "paper.tex": 15, "article.tex": 15}
UNLIKELY = {"supp": 15, "appendix": 15}
DEPTH = 3
README = "00readme.json"
MOST_CONTEXTS = 200

_INCLUDE = re.compile(r"\\(?:input|include)\s*\{([^{}]+)\}")


def main_score(name: Column, text: Column) -> Column:
    """SC9: markers in the text and a usual file name count for a file; folders and supplements against it."""
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    parts = [F.when(F.contains(text, F.lit(m)), w).otherwise(0) for m, w in MARKERS.items()] + [F.when(base == n, w).otherwise(0) for n, w in BASENAMES.items()]
    against = [F.when(F.contains(F.lower(name), F.lit(n)), w).otherwise(0) for n, w in UNLIKELY.items()]
    depth = DEPTH * (F.size(F.split(name, "/")) - 1)
    return sum(parts, F.lit(0)) - sum(against, F.lit(0)) - depth


def _target(current: str, wanted: str, files: dict[str, str]) -> str | None:
    """The file that an \\input names: beside the current one, at the top, or else the only one of that base name."""
    wanted = wanted.strip() + ("" if wanted.strip().endswith(".tex") else ".tex")
    for place in ([f"{dirname(current)}/{wanted}"] if dirname(current) else []) + [wanted]:
        if (exact := next((f for f in files if f.strip("./") == place.strip("./")), None)) is not None:
            return exact
        alike = [f for f in files if basename(f) == basename(place)]
        if len(alike) == 1:
            return alike[0]
    return None


def inlined(main: str, files: dict[str, str]) -> tuple[str, list[str]]:
    """The main file with its inputs in place between marks, and their names in order; a file's text comes in only once."""
    out, included, seen = [], [], {main}
    stack = [(main, 0)]
    while stack:
        name, at = stack.pop()
        text = files.get(name, "")
        m = _INCLUDE.search(text, at)
        target = _target(name, m[1], files) if m else None
        if m is None:
            out.append(text[at:] + (f"\n% END included from {name}\n" if stack else ""))
            continue
        stack.append((name, m.end()))
        if target is None:
            out.append(text[at : m.end()])
            continue
        out.append(f"{text[at : m.start()]}\n% BEGIN included from {target}\n")
        included.append(target)
        if target in seen:
            out.append(f"\n% END included from {target}\n")
        else:
            seen.add(target)
            stack.append((target, 0))
    return "".join(out), included


def hinted(files: DataFrame) -> DataFrame:
    """SC9: (package, hint): the .tex file that a package's 00README.json names as top level, as written or else by a base name that only one file has; the first source that is there counts."""
    trimmed = lambda c: F.regexp_replace(c, r"^[./]+|[./]+$", "")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    readme = files.filter(F.lower(base(F.col("name"))) == README)
    told = F.from_json("content", "sources array<struct<usage:string, filename:string>>")["sources"]
    wanted = readme.select("package", F.posexplode(told).alias("place", "s")).filter("s.usage = 'toplevel' and s.filename <> ''")
    wanted = wanted.select(F.col("package").alias("p"), "place", trimmed(F.col("s.filename")).alias("wanted"))
    own = files.filter(F.col("name").endswith(".tex")).select("package", "name", trimmed(F.col("name")).alias("path"))
    same = own["package"].eqNullSafe(wanted["p"])
    exact = own.join(wanted, same & (F.col("path") == F.col("wanted"))).select("package", "place", F.lit(0).alias("way"), "name")
    alike = own.join(wanted, same & (base(F.col("path")) == base(F.col("wanted")))).groupBy("package", "place").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).filter("n = 1")
    both = exact.unionByName(alike.select("package", "place", F.lit(1).alias("way"), "name"))
    return both.groupBy("package").agg(F.min(F.struct("place", "way", "name")).alias("b")).select("package", F.col("b.name").alias("hint"))


def assembled(files: DataFrame) -> DataFrame:
    """SC9: (package, main, source, included) of files(package, name, content): the .tex files of one paper meet in one row.

    The main file is the one that 00README.json hints at, else the one of the highest score, of equal ones the first by name;
    null contents are empty, and packages without a .tex file stay out.
    """
    own = files.filter(F.col("name").endswith(".tex")).select("package", "name", F.coalesce("content", F.lit("")).alias("content"))
    order = F.struct(main_score(F.col("name"), F.col("content")).alias("score"), F.col("name"))
    packed = own.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("files"), F.max(order["score"]).alias("best"))
    names, texts = F.transform("files", lambda f: f["name"]), F.transform("files", lambda f: f["content"])
    main = F.coalesce("hint", F.get(F.filter("files", lambda f: main_score(f["name"], f["content"]) == F.col("best")), 0)["name"])
    hints = hinted(files).withColumnRenamed("package", "__p")
    packed = packed.join(hints, packed["package"].eqNullSafe(hints["__p"]), "left")
    run = by_row(lambda m, n, x: inlined(m, dict(zip(n, x, strict=True))), "source string, included array<string>")
    return packed.select("package", main.alias("main"), run(main, names, texts).alias("r")).select("package", "main", "r.*")


def paper_records(papers: DataFrame) -> DataFrame:
    """PF19: (paper_id, metadata, content_units, contexts, cites) beside the other columns of papers(arxiv_id, known, x, entries).

    `known` (title, authors, year, abstract) goes before what the source says (x, of tex_structure) unless it is null or
    empty; entries is an array of references, one a key. At most MOST_CONTEXTS citations are carried, as contexts of a record are few.
    """
    x, known = F.col("x"), F.col("known")
    some = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))
    authors = F.when(F.size(F.coalesce(known["authors"], F.array().cast("array<string>"))) > 0, known["authors"]).otherwise(x["authors"])
    keyed = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["key"], F.struct(e["title"].alias("title"), e["arxiv_id"].alias("arxiv_id")))))
    papers = papers.withColumn("entries", keyed)
    reference = lambda c: F.try_element_at("entries", c["key"])
    cited = lambda c: F.when(reference(c)["arxiv_id"] != "", F.concat(F.lit("paper::"), reference(c)["arxiv_id"])).otherwise("")
    contexts = F.transform(F.slice(x["cites"], 1, MOST_CONTEXTS), lambda c: F.struct(cited(c).alias("cited_paper_id"), c["key"].alias("cite_key"), F.coalesce(reference(c)["title"], F.lit("")).alias("reference_title"), c["context"].alias("context"), c["section"].alias("section")))
    arxiv = F.coalesce("arxiv_id", F.lit(""))
    of = lambda kind: F.transform(F.filter(x["floats"], lambda f: f["kind"] == kind), lambda f: F.struct(f["label"].alias("label"), f["caption"].alias("caption")))
    metadata = F.struct(some(known["title"], x["title"]).alias("title"), authors.alias("authors"), F.coalesce(F.nullif(known["year"], F.lit("")), F.lit("unknown")).alias("year"), F.when(arxiv != "", F.concat(F.lit("arXiv "), arxiv)).otherwise("").alias("venue"), F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/abs/"), arxiv)).otherwise("").alias("url"))
    units = F.struct(some(known["abstract"], x["abstract"]).alias("abstract"), x["sections"].alias("sections"), x["has_appendix"].alias("has_appendix"), x["has_supplement"].alias("has_supplement"), of("figure").alias("figures"), of("table").alias("tables"))
    others = [c for c in papers.columns if c not in ("arxiv_id", "known", "x", "entries")]
    rows = papers.select(*others, F.concat(F.lit("paper::"), arxiv).alias("paper_id"), metadata.alias("metadata"), units.alias("content_units"), contexts.alias("contexts"))
    return rows.withColumn("cites", F.filter(F.transform("contexts", lambda c: c["cited_paper_id"]), lambda c: c != ""))


def parsed_packages(files: DataFrame, known: DataFrame) -> DataFrame:
    """DC14: the records of files(package, name, content) with known(package, arxiv_id, title, authors, year, abstract), and their counts."""
    sources = assembled(files).select("package", tex.tex_structure(F.col("source")).alias("x"), "main", F.size("included").alias("n_included"))
    entries = package_references(files.filter(F.col("name").rlike(r"\.(bib|bbl)$"))).groupBy("package").agg(F.array_sort(F.collect_list(F.struct("key", "title", "arxiv_id"))).alias("entries"))
    none = F.array().cast("array<struct<key:string, title:string, arxiv_id:string>>")
    told = known.select("package", "arxiv_id", F.struct("title", "authors", "year", "abstract").alias("known"))
    met = sources.join(entries, "package", "left").join(told, "package", "left").withColumn("entries", F.coalesce("entries", none))
    counts = met.select("package", "main", "n_included", F.size("entries").alias("n_references"), F.size("x.cites").alias("n_citations"), F.size("x.sections").alias("n_sections"), "arxiv_id", "known", "x", "entries")
    return paper_records(counts)


BLOCK = "struct<type:string, text:string, text_level:int, page_idx:int, list_items:array<string>, image_caption:array<string>, table_caption:array<string>>"


def content_blocks(lists: DataFrame) -> DataFrame:
    """SC7: (..., pos, type, text, text_level, page_idx, list_items, captions) of lists(content): JSON lists of blocks, or of pages of blocks.

    Fields that a block lacks are null; texts that are no such list have no blocks.
    """
    v = F.col("content")
    paged = v.rlike(r"^\s*\[\s*\[")
    pages = F.transform(F.from_json(v, f"array<array<{BLOCK}>>"), lambda p, i: F.transform(F.coalesce(p, F.array().cast(f"array<{BLOCK}>")), lambda b: b.withField("page_idx", F.coalesce(b["page_idx"], i))))
    blocks = F.when(paged, F.flatten(pages)).otherwise(F.from_json(v, f"array<{BLOCK}>"))
    others = [c for c in lists.columns if c != "content"]
    b = lambda f: F.col(f"__b.{f}")
    captions = F.concat(*[F.coalesce(b(f), F.array().cast("array<string>")) for f in ("image_caption", "table_caption")])
    return lists.select(*others, F.posexplode(blocks).alias("pos", "__b")).filter("__b is not null").select(*others, "pos", *[b(f).alias(f) for f in ("type", "text", "text_level", "page_idx", "list_items")], captions.alias("captions"))


def chosen_references(papers: DataFrame, least: int = 5, share: float = 0.25) -> DataFrame:
    """DC9: (paper, source, chosen, warnings) of papers(paper, listed, marked): candidates of the content list, else of Markdown.

    Null arrays are missing files. Where both are there and their counts differ by more than `least` and more than `share`
    of the Markdown count, a warning says so.
    """
    none = F.array().cast("array<string>")
    listed, marked = F.coalesce("listed", none), F.coalesce("marked", none)
    back = (F.size(listed) == 0) & F.col("marked").isNotNull()
    chosen = F.when(back, marked).otherwise(listed)
    apart = (F.size(listed) > 0) & (F.size(marked) > 0) & (F.abs(F.size(marked) - F.size(listed)) > F.greatest(F.lit(least), F.floor(share * F.size(marked))))
    warnings = F.array_compact(F.array(F.when(F.col("listed").isNull(), "missing content list"), F.when(apart, F.concat(F.lit("content list has "), F.size(listed), F.lit(" candidates, Markdown "), F.size(marked))), F.when(F.col("marked").isNull(), "missing Markdown"), F.when(F.size(chosen) == 0, "no references")))
    return papers.select("paper", F.when(back, "markdown_fallback").otherwise("content_list").alias("source"), chosen.alias("chosen"), warnings.alias("warnings"))


def merged_texts(blocks: DataFrame) -> DataFrame:
    """WN6: (doc, first_idx, text) of blocks(doc, idx, text, merge_prev): blank texts go, continuations join the text before them.

    The joint is a blank, or nothing where the continuation has a Chinese character.
    """
    order = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = blocks.filter(F.trim("text") != "")
    runs = full.withColumn("run", F.sum(F.when(F.coalesce("merge_prev", F.lit(False)), 0).otherwise(1)).over(order))
    first = F.row_number().over(Window.partitionBy("doc", "run").orderBy("idx")) == 1
    pieces = runs.withColumn("piece", F.concat(F.when(first | F.col("text").rlike("[一-鿿]"), "").otherwise(" "), F.col("text")))
    return pieces.groupBy("doc", "run").agg(F.min("idx").alias("first_idx"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "piece"))), lambda p: p["piece"]), "").alias("text")).drop("run")
