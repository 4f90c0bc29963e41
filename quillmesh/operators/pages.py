"""Pages put together from layout blocks: figures with their parts, captions and footnotes, and their renderings.

Blocks are rows (doc, page, idx, type, sub_type, x0, y0, x1, y1, angle, content, merge_prev), idx counting from 0 in reading
order; (doc, page, idx) is unique. Every step is a join or a window within a page, and nested results are built last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as t

# Block types by what becomes of them.
VISUAL = ("image", "chart", "table")
CONTAINER = "image_block"
CAPTIONS = ("image_caption", "table_caption", "code_caption", "caption")
FOOTNOTES = ("image_footnote", "table_footnote", "footnote")
DISCARDED = ("header", "footer", "page_number", "aside_text", "page_footnote")
CODE = ("code", "algorithm")
STRUCTURAL = ("equation_block", "list")
TITLES = ("title", "doc_title", "paragraph_title")
#: The share of a sub-image's area within its container.
ABSORBED = 0.9
#: Two gaps between boxes count as equal up to this share of the page.
EDGE_TOLERANCE = 0.003

BOX = ("x0", "y0", "x1", "y1")
PAGE = ["doc", "page"]


def _corners(c: str | None = None) -> tuple[Column, ...]:
    return tuple(F.col(f"{c}.{b}" if c else b) for b in BOX)


def kind_of(kind: Column) -> Column:
    """caption, footnote, discarded, visual, structural or flow; unknown and null types are flow."""
    named = {"caption": CAPTIONS, "footnote": FOOTNOTES, "discarded": DISCARDED, "visual": (CONTAINER, *VISUAL, *CODE), "structural": STRUCTURAL}
    return reduce(lambda so_far, n: so_far.when(kind.isin(*named[n]), n), list(named)[1:], F.when(kind.isin(*CAPTIONS), "caption")).otherwise("flow")


def absorbed(blocks: DataFrame, least: float = ABSORBED) -> DataFrame:
    """blocks with (container, bbox_in_parent) for images and charts that lie to `least` (over a half) of their area in an image_block of their page, null for all others.

    The largest share wins, then the smaller container, then the first. A member that lies so far inside has its centre in
    the container, so the two meet in a cell of a grid: a container takes the at most four cells it touches of the grid
    whose cells are about its own size, a member the cell of its centre in each grid in use on its page. They meet in windows
    within the page, so blocks that are together by page are not shuffled again.
    """
    placed = F.col("doc").isNotNull() & F.col("page").isNotNull()
    outer, inner = placed & (F.col("type") == CONTAINER), placed & F.col("type").isin("image", "chart")
    x0, y0, x1, y1 = _corners()
    side = F.greatest(x1 - x0, y1 - y0)
    grid = F.when(side > 0, F.ceil(F.log2(side))).otherwise(0).cast("int")
    at = lambda v, g: F.floor(v / F.pow(F.lit(2.0), g)).cast("long")
    cell = lambda g, cx, cy: F.struct(g.alias("grid"), cx.alias("cx"), cy.alias("cy"))
    touched = F.flatten(F.transform(F.sequence(at(x0, grid), at(x1, grid)), lambda cx: F.transform(F.sequence(at(y0, grid), at(y1, grid)), lambda cy: cell(grid, cx, cy))))
    centre = F.transform("grids", lambda g: cell(g, at((x0 + x1) / 2, g), at((y0 + y1) / 2, g)))
    rows = blocks.withColumn("grids", F.collect_set(F.when(outer, grid)).over(Window.partitionBy(*PAGE)))
    rows = rows.select(*blocks.columns, F.posexplode_outer(F.when(outer, touched).when(inner, centre)).alias("nth", "cell"))
    rows = rows.withColumn("met", F.collect_list(F.when(outer, F.struct(F.col("idx").alias("container"), F.struct(*BOX).alias("outer")))).over(Window.partitionBy(*PAGE, "cell")))
    box = lambda c: tuple(c["outer"][b] for b in BOX)
    shares = F.transform("met", lambda c: F.struct((-t.box_overlap(_corners(), box(c))).alias("less"), t.box_area(*box(c)).alias("area"), c["container"].alias("container"), c["outer"].alias("outer")))
    rows = rows.withColumn("best", F.when(inner, F.array_min(F.filter(shares, lambda c: -c["less"] >= least)))).drop("met", "cell")
    rows = rows.withColumn("best", F.min("best").over(Window.partitionBy(*PAGE, "idx"))).filter("coalesce(nth, 0) = 0")
    bbox = F.when(F.col("best").isNotNull(), t.relative_box(_corners(), _corners("best.outer")))
    return rows.withColumns({"container": F.col("best.container"), "bbox_in_parent": bbox}).drop("best", "nth")


def owners(blocks: DataFrame, by: list[str], between: Callable[[tuple, tuple], Column] = t.box_centre_distance) -> DataFrame:
    """blocks(by, idx, kind, type, box) with parent: the visual block that a caption or footnote belongs to, null where none is next to it; blocks of null kind are passed over.

    A caption belongs to a visual block next to it with captions alone between them, a footnote to one before it with
    captions and footnotes alone between. Of two, the one with the smaller gap between the boxes; if these are equal up to
    EDGE_TOLERANCE, the later of two tables, else the nearer centre by `between`, then the earlier. Each block sees its neighbours
    through windows that run forwards and backwards over the page once; no pairs of blocks are formed.
    """
    before = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("idx", "kind", "type", *BOX)
    body = F.when(F.col("kind") != "caption", own)
    seen = blocks.withColumns({"prev": F.last(body, ignorenulls=True).over(before), "next": F.last(body, ignorenulls=True).over(after), "above": F.last(F.when(~F.col("kind").isin("caption", "footnote"), own), ignorenulls=True).over(before)})
    seen = seen.withColumns({c: F.when(F.col(f"{c}.kind") == "visual", F.col(c)) for c in ("prev", "next", "above")})
    gap = {c: t.box_gap(_corners(), _corners(c)) for c in ("prev", "next")}
    centre = {c: between(_corners(), _corners(c)) for c in ("prev", "next")}
    later = F.when(F.abs(gap["prev"] - gap["next"]) > EDGE_TOLERANCE, gap["next"] < gap["prev"]).when((F.col("prev.type") == "table") & (F.col("next.type") == "table"), True).otherwise(centre["next"] < centre["prev"])
    caption = F.when(F.col("prev").isNull() | (F.col("next").isNotNull() & later), F.col("next.idx")).otherwise(F.col("prev.idx"))
    parent = F.when(F.col("kind") == "caption", caption).when(F.col("kind") == "footnote", F.col("above.idx"))
    return seen.withColumn("parent", parent).drop("prev", "next", "above")


def plain_brackets(content: Column) -> Column:
    r"""\[..\] as [..], where both marks stand equally often."""
    times = lambda mark: (F.char_length(content) - F.char_length(F.replace(content, F.lit(mark), F.lit("")))) / 2
    return F.when((times("\\[") > 0) & (times("\\[") == times("\\]")), F.regexp_replace(content, r"\\\[(.*?)\\\]", "[$1]")).otherwise(content)


def tidy(content: Column) -> Column:
    r"""The text of a block: brackets plain, \(..\) as $..$ without blanks at its ends; null as nothing."""
    return F.regexp_replace(plain_brackets(F.coalesce(content, F.lit(""))), r"(?s)\\\(\s*(\S.*?|)\s*\\\)", r"\$$1\$")


def display_math(content: Column) -> Column:
    r"""A formula of its own, without \[ and \] around it, between lines of $$."""
    bare = t.stripped(content)
    inside = F.when(bare.startswith("\\[") & bare.endswith("\\]"), t.stripped(F.substring(bare, F.lit(3), F.char_length(bare) - 4))).otherwise(bare)
    return F.concat(F.lit("$$\n"), inside, F.lit("\n$$"))


def assembled_items(blocks: DataFrame) -> DataFrame:
    """DC6, flat: one row for each item of a page, (doc, page, block, kind, type, sub_type, is_container, bbox, angle, content, merge_prev, orphan_child, sub_images, captions, footnotes).

    kind is visual, flow or discarded. A visual item holds its sub-images (block, type, bbox_in_parent), captions and footnotes
    (block, text) in reading order; absorbed sub-images and owned captions and footnotes are no items themselves, and structural
    blocks are left out. Captions and footnotes without an owner stay as flow, marked orphan_child. Containers count as
    images; code and algorithms as code with the type as sub_type. Null content is empty; pages without blocks have no rows.
    """
    rows = absorbed(blocks).withColumn("kind", F.when(F.col("container").isNull(), kind_of(F.col("type"))))
    rows = owners(rows, PAGE)
    role = F.when(F.col("container").isNotNull(), "sub_image").when(F.col("parent").isNotNull(), F.col("kind")).otherwise("main")
    rows = rows.withColumns({"role": role, "block": F.coalesce("container", "parent", "idx")})
    coded, contained = F.col("type").isin(*CODE), F.col("type") == CONTAINER
    content = F.when(F.col("kind") == "discarded", tidy(F.col("content"))).otherwise(F.coalesce("content", F.lit("")))
    main = (
        F.when(F.col("kind").isin("caption", "footnote"), "flow").otherwise(F.col("kind")).alias("kind"),
        F.when(contained, "image").when(coded, "code").otherwise(F.col("type")).alias("type"),
        F.when(coded, F.col("type")).otherwise(F.col("sub_type")).alias("sub_type"),
        F.coalesce(contained, F.lit(False)).alias("is_container"),
        F.array(*BOX).alias("bbox"),
        "angle",
        content.alias("content"),
        F.coalesce("merge_prev", F.lit(False)).alias("merge_prev"),
        F.col("kind").isin("caption", "footnote").alias("orphan_child"),
    )
    of_block = Window.partitionBy(*PAGE, "block")
    part = lambda r, value: F.sort_array(F.collect_list(F.when(F.col("role") == r, value)).over(of_block))
    child = F.struct(F.col("idx").alias("block"), tidy(F.col("content")).alias("text"))
    sub = F.struct(F.col("idx").alias("block"), "type", "bbox_in_parent")
    items = rows.withColumns({"sub_images": part("sub_image", sub), "captions": part("caption", child), "footnotes": part("footnote", child)}).filter("role = 'main'")
    return items.select(*PAGE, "block", *main, "sub_images", "captions", "footnotes").filter("kind <> 'structural'")


def assemble(blocks: DataFrame) -> DataFrame:
    """DC6: (doc, page, items, discarded): the items of each page in reading order, nested; discarded ones apart."""
    items = assembled_items(blocks)
    item = F.struct(*[c for c in items.columns if c not in PAGE])
    dropped = F.struct("block", "type", "bbox", "content")
    inside = lambda keep, value: F.sort_array(F.collect_list(F.when(keep, value)))
    gone = F.col("kind") == "discarded"
    return items.groupBy(*PAGE).agg(inside(~gone, item).alias("items"), inside(gone, dropped).alias("discarded"))


def crop_plan(items: DataFrame) -> DataFrame:
    """DC7: (doc, page, block, type, bbox, angle, name): one picture for each figure, chart and table; containers whole, code none."""
    name = F.format_string("p%03d-b%02d-%s.png", "page", "block", "type")
    return items.filter((F.col("kind") == "visual") & F.col("type").isin(*VISUAL)).select(*PAGE, "block", "type", "bbox", "angle", name.alias("name"))


def _fenced(content: Column) -> Column:
    bare = t.stripped(content)
    return F.when(bare == "", "").when(bare.startswith("```"), bare).otherwise(F.concat(F.lit("```\n"), bare, F.lit("\n```")))


def _paragraphs(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n\n")


def item_markdown(items: DataFrame, crops: DataFrame, table_html: bool = True) -> DataFrame:
    """(doc, page, block, kind, merge_prev, text) of items that are not discarded, with crops(doc, page, block, path) of pictures.

    A figure and its captions and footnotes stand in the order of the page. Tables are given as they are, or else as their picture; what was
    read off an image or chart goes into a folded block. Titles are of level one.
    """
    content, kind = F.col("content"), F.col("type")
    picture = F.when(F.col("path").isNotNull(), F.concat(F.lit("![]("), "path", F.lit(")")))
    bare = t.stripped(content)
    has_html = (bare != "") & F.lit(table_html)
    tabled = F.when(has_html, _paragraphs(bare, F.when(F.col("path").isNotNull(), F.concat(F.lit("<!-- crop: "), "path", F.lit(" -->"))))).otherwise(F.coalesce(picture, F.lit("")))
    summary = F.coalesce(F.nullif("sub_type", F.lit("")), F.when(kind == "chart", "chart content").otherwise("image content"))
    details = F.when(bare != "", F.concat(F.lit("<details>\n<summary>"), summary, F.lit("</summary>\n\n"), content, F.lit("\n</details>")))
    body = F.when(kind == "code", _fenced(content)).when(kind == "table", tabled).otherwise(_paragraphs(picture, details))
    segments = F.array_sort(F.concat(F.array(F.struct("block", body.alias("text"))), "captions", "footnotes"))
    visual = F.array_join(F.transform(F.filter(segments, lambda s: t.stripped(s["text"]) != ""), lambda s: s["text"]), "\n\n")
    title = F.concat(F.lit("# "), t.stripped(F.regexp_replace(tidy(content), r"\s+", " ")))
    flow = F.when(bare == "", "").when(kind == "equation", display_math(plain_brackets(content))).when(kind.isin(*TITLES), title).otherwise(tidy(content))
    rows = items.filter("kind <> 'discarded'").join(crops.select(*PAGE, "block", "path"), [*PAGE, "block"], "left")
    return rows.select(*PAGE, "block", "kind", "merge_prev", F.when(F.col("kind") == "visual", visual).otherwise(flow).alias("text"))


def placed_markdown(items: DataFrame, crops: DataFrame, table_html: bool = True) -> DataFrame:
    """(doc, page, block, gap, text, start): each item's text, what stands before it, and the character at which it begins in its document's Markdown.

    A text block that continues the one before it, across pages too, is joined to it by a blank, or by nothing if it holds
    Chinese characters; others are paragraphs of their own. Starts are running sums over a document in reading order.
    """
    rows = item_markdown(items, crops, table_html).filter(t.stripped(F.col("text")) != "")
    order = Window.partitionBy("doc").orderBy("page", "block")
    joined = (F.col("kind") == "flow") & F.col("merge_prev")
    gap = F.when(F.row_number().over(order) == 1, "").when(~joined, "\n\n").when(F.col("text").rlike("[一-鿿]"), "").otherwise(" ")
    rows = rows.withColumn("gap", gap)
    ahead = F.sum(F.char_length("gap") + F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(*PAGE, "block", "gap", "text", (F.coalesce(ahead, F.lit(0)) + F.char_length("gap")).alias("start"))


def to_markdown(items: DataFrame, crops: DataFrame, table_html: bool = True) -> DataFrame:
    """DC7: (doc, markdown), with a line end at the end; documents without any text have none."""
    rows = placed_markdown(items, crops, table_html)
    parts = F.array_sort(F.collect_list(F.struct("page", "block", F.concat("gap", "text").alias("text"))))
    return rows.groupBy("doc").agg(F.concat(F.array_join(F.transform(parts, lambda x: x["text"]), ""), F.lit("\n")).alias("markdown"))


def to_content_list(items: DataFrame, crops: DataFrame) -> DataFrame:
    """DC7: (doc, page_idx, block, type, text, text_level, text_format, bbox, img_path, captions, footnotes, body, sub_type, sub_images), a row for each entry.

    Flow without content has no entry. body holds a table's, code's or picture's content; null means that the entry has no such field.
    """
    visual, kind = F.col("kind") == "visual", F.col("type")
    flow_text = F.when(kind == "equation", display_math(F.col("content"))).otherwise(tidy(F.col("content")))
    rows = items.filter("kind <> 'discarded'").join(crops.select(*PAGE, "block", "path"), [*PAGE, "block"], "left").filter(visual | (t.stripped(F.col("content")) != ""))
    texts = lambda c: F.when(visual, F.transform(c, lambda x: x["text"]))
    return rows.select(
        "doc",
        (F.col("page") - 1).alias("page_idx"),
        "block",
        F.when(~visual & kind.isin(*TITLES), "text").otherwise(kind).alias("type"),
        F.when(~visual, flow_text).alias("text"),
        F.when(~visual & kind.isin(*TITLES), 1).alias("text_level"),
        F.when(~visual & (kind == "equation"), "latex").alias("text_format"),
        F.transform("bbox", lambda v: F.round(v, 4)).alias("bbox"),
        F.when(visual & (kind != "code"), F.coalesce("path", F.lit(""))).alias("img_path"),
        texts("captions").alias("captions"),
        texts("footnotes").alias("footnotes"),
        F.when(visual, F.col("content")).alias("body"),
        F.when(visual, F.nullif("sub_type", F.lit(""))).alias("sub_type"),
        F.when(F.size("sub_images") > 0, F.col("sub_images")).alias("sub_images"),
    )
