"""Papers as text: summaries, section trees, contents, headers, and pictures under local names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as t

ABS = "https://arxiv.org/abs/"
IMAGE = r"(!\[(?:\\.|[^\\\]])*\]\()(https?://[^)\s]+)\)"


def _some(c: Column) -> Column:
    """The text, or null if it is null or empty."""
    return F.nullif(c, F.lit(""))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _lines(*parts: Column) -> Column:
    """The parts that are not null, a line each."""
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def anchor_html(name: Column) -> Column:
    """The target of links within a document, under both attributes that renderers look for."""
    safe = name
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        safe = F.replace(safe, F.lit(mark), F.lit(entity))
    return F.concat(F.lit('<a id="'), safe, F.lit('" name="'), safe, F.lit('"></a>'))


def format_papers(papers: DataFrame, sections: DataFrame, toc: bool = True, abstract_in_tree: bool = True) -> DataFrame:
    """DC5: (paper, summary, tree, content, header) of papers(paper, arxiv_id, version, title, authors, abstract, tokens) and sections(paper, pos, depth, level, title, markdown, anchor).

    Sections come in reading order by pos, children after their parent, with depth from 0. tree indents titles by four blanks
    a depth, the table of contents by two; headings have up to six #, under a line with their anchor. Null and empty parts
    stay out; papers without sections have none; tokens is an estimate made elsewhere, or null. header is a block of YAML.
    """
    title = F.coalesce(F.col("title"), F.lit(""))
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.col("level"), F.lit(6))), F.lit(" "), title)
    anchored = F.concat(F.coalesce(F.concat(anchor_html(_some(F.col("anchor"))), F.lit("\n")), F.lit("")), heading)
    rows = sections.select(
        "paper",
        F.struct(
            "pos",
            F.concat(F.repeat(F.lit(" "), 4 * F.col("depth")), title).alias("branch"),
            F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), title).alias("entry"),
            F.array_join(F.array_compact(F.array(anchored, _some(F.col("markdown")))), "\n\n").alias("block"),
        ).alias("s"),
    )
    held = rows.groupBy("paper").agg(F.array_sort(F.collect_list("s")).alias("s"))
    joined = papers.join(held, "paper", "left").withColumn("s", F.coalesce("s", F.array().cast(held.schema["s"].dataType)))
    each = lambda name: F.transform("s", lambda x: x[name])
    count, authors = F.size("s").cast("string"), F.coalesce("authors", F.array().cast("array<string>"))
    named = F.size(authors) > 0
    abstract, tokens = _some(F.col("abstract")), _some(F.col("tokens").cast("string"))
    head = F.array(F.lit("Sections:"), *([F.lit("Abstract")] if abstract_in_tree else []))
    listed = F.when((F.size("s") > 0) & F.lit(toc), F.concat(F.lit("## Contents\n"), F.array_join(each("entry"), "\n")))
    told = F.array(listed, F.when(abstract.isNotNull(), "## Abstract"), _some(t.stripped(abstract)))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    summary = _lines(field("Title", _some(F.col("title"))), field("ArXiv", F.col("arxiv_id")), field("Version", _some(F.col("version"))), F.when(named, field("Authors", F.array_join(authors, ", "))), field("Sections", count), field("Estimated tokens", tokens))
    header = _lines(
        F.lit("---"),
        field("title", _quoted(_some(F.col("title")))),
        F.concat(F.lit('version: "'), _some(F.col("version")), F.lit('"')),
        F.when(named, F.concat(F.lit("authors: ["), F.array_join(F.transform(authors, _quoted), ", "), F.lit("]"))),
        F.concat(F.lit(f'url: "{ABS}'), "arxiv_id", F.lit('"')),
        field("sections", count),
        F.concat(F.lit('estimated_tokens: "'), tokens, F.lit('"')),
        F.lit("---"),
    )
    # a paper without sections has an empty last line in its tree
    tree = F.array_join(F.concat(head, F.when(F.size("s") > 0, each("branch")).otherwise(F.array(F.lit("")))), "\n")
    return joined.select("paper", summary.alias("summary"), tree.alias("tree"), t.stripped(F.array_join(F.concat(F.array_compact(told), each("block")), "\n\n")).alias("content"), header.alias("header"))


def image_name(url: Column) -> Column:
    """ST35: the last part of a URL's path with other than letters, digits, _ . and - as _; image if there is none."""
    path = F.regexp_replace(F.split(url, r"\?", 2)[0], "/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.coalesce(_some(last), F.lit("image")), r"(?U)[^\w.\-]+", "_")


def _numbered(name: Column, k: Column) -> Column:
    """A name with -k before its ending; one without ending, or of an ending alone, gets it last."""
    ending = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    return F.concat(F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ending)), F.lit("-"), k.cast("string"), ending)


def image_names(urls: Column) -> Column:
    """ST35: array<struct<url, name>> of an array of URLs, each once in its order, under names that no earlier one has."""
    none = F.array().cast("array<struct<url:string, name:string>>")

    def step(done: Column, url: Column) -> Column:
        used = F.transform(done, lambda d: d["name"])
        name = image_name(url)
        free = F.get(F.filter(F.sequence(F.lit(2), F.size(done) + 2), lambda k: ~F.array_contains(used, _numbered(name, k))), 0)
        chosen = F.when(F.array_contains(used, name), _numbered(name, free)).otherwise(name)
        return F.concat(done, F.array(F.struct(url.alias("url"), chosen.alias("name"))))

    return F.aggregate(F.array_distinct(urls), none, step)


def remote_images(markdown: Column) -> Column:
    """The URLs of a Markdown text's remote pictures, in order."""
    return F.regexp_extract_all(F.coalesce(markdown, F.lit("")), F.lit(IMAGE), 2)


def localized(markdown: Column, names: Column, prefix: str) -> Column:
    """A Markdown text whose pictures of names(url, name) are linked under prefix/name; links that are no pictures stay."""
    place = F.lit(prefix.replace("\\", "\\\\").replace("$", "\\$") + "/")

    def step(text: Column, one: Column) -> Column:
        return F.regexp_replace(text, F.concat(F.lit(r"(!\[(?:\\.|[^\\\]])*\]\()\Q"), one["url"], F.lit(r"\E\)")), F.concat(F.lit("$1"), place, one["name"], F.lit(")")))

    return F.aggregate(names, markdown, step)
