"""Queries of page assembly over lines of orders as layout blocks, with their SQL.

Types, boxes and contents vary from block to block; the SQL compares all blocks of a page with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillmesh.operators import pages as p
from quillmesh.session import table

TYPES = ("image_block", "image", "chart", "image", "table", "image_caption", "table_caption", "image_footnote", "header", "code", "equation", "title", "list", "text", "caption", "page_number", "table", "algorithm", "text", "chart", "image", "table_footnote", "paragraph_title")


def page_blocks(spark, sf_dir) -> DataFrame:
    """Eight orders a page, four pages a document."""
    c = F.col
    order = Window.partitionBy("doc", "page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    number = lambda name: c(name).cast("string")
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), ((c("l_partkey") * 7 + c("l_suppkey") * 3 + c("l_linenumber")) % len(TYPES) + 1).cast("int"))
    content = F.element_at(
        F.array(
            F.lit(None).cast("string"),
            F.lit(" \n "),
            F.concat(F.lit("see \\( x_"), number("l_suppkey"), F.lit(" \\) and \\[2\\] in \\(y\n\\)")),
            F.concat(F.lit("\\[ a = "), number("l_linenumber"), F.lit(" \\]")),
            F.concat(F.lit("  unpaired \\[ "), number("l_partkey"), F.lit("  blanks\t")),
            F.concat(F.lit("```x\n"), number("l_partkey"), F.lit("\n```")),
            F.concat(F.lit("中文 "), number("l_partkey")),
            F.concat(F.lit("<table>"), number("l_suppkey"), F.lit("</table>")),
        ),
        ((c("l_partkey") + c("l_linenumber") * 5) % 8 + 1).cast("int"),
    )
    box = table(spark, sf_dir, "lineitem").select("*", (c("l_orderkey") / 32).cast("long").alias("doc"), ((c("l_orderkey") / 8).cast("long") % 4 + 1).cast("int").alias("page"), kind.alias("type"))
    big = c("type") == "image_block"
    x0, y0 = (c("l_partkey") % 16) / 32.0, (c("l_suppkey") % 16) / 32.0
    wide = F.when(big, 0.5).otherwise(F.lit(0.05) + (c("l_quantity").cast("long") % 5) / 40.0)
    return box.select(
        "doc", "page", (F.row_number().over(order) - 1).cast("int").alias("idx"), "type",
        F.when(c("l_returnflag") == "R", F.concat(F.lit("sub "), "l_linestatus")).when(c("l_returnflag") == "A", "").alias("sub_type"),
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + wide).cast("double").alias("x1"), (y0 + wide).cast("double").alias("y1"),
        F.when(c("l_linenumber") == 1, 90).alias("angle"), content.alias("content"), (c("l_linestatus") == "O").alias("merge_prev"),
    )


def _list(kinds) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


_TIDY = r"regexp_replace(regexp_replace({0}, '(?s)\\\(\s*(\S.*?|)\s*\\\)', '$\1$', 'g'), '^$', '')"
_PLAIN = r"CASE WHEN contains({0}, '\[') AND length(replace({0}, '\[', '')) = length(replace({0}, '\]', '')) THEN regexp_replace({0}, '\\\[(.*?)\\\]', '[\1]', 'g') ELSE {0} END"
_TIDIED = _TIDY.format("(" + _PLAIN + ")")
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_DISPLAY = "('$$' || chr(10) || (CASE WHEN starts_with({0}, '\\[') AND ends_with({0}, '\\]') THEN " + _STRIP.format("substr({0}, 3, length({0}) - 4)") + " ELSE {0} END) || chr(10) || '$$')"

_BLOCKS = f"""typed AS (SELECT *, l_orderkey // 32 AS doc, CAST((l_orderkey // 8) % 4 + 1 AS INT) AS page, [{_list(TYPES)}][(l_partkey * 7 + l_suppkey * 3 + l_linenumber) % {len(TYPES)} + 1] AS type FROM lineitem),
sized AS (SELECT *, (l_partkey % 16) / 32.0::DOUBLE AS x0, (l_suppkey % 16) / 32.0::DOUBLE AS y0, CASE WHEN type = 'image_block' THEN 0.5::DOUBLE ELSE 0.05::DOUBLE + (l_quantity::BIGINT % 5) / 40.0::DOUBLE END AS wide FROM typed),
blocks AS MATERIALIZED (SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS INT) AS idx, type,
 CASE l_returnflag WHEN 'R' THEN 'sub ' || l_linestatus WHEN 'A' THEN '' END AS sub_type, x0, y0, x0 + wide AS x1, y0 + wide AS y1, CASE WHEN l_linenumber = 1 THEN 90 END AS angle,
 [NULL, ' ' || chr(10) || ' ', 'see \\( x_' || l_suppkey || ' \\) and \\[2\\] in \\(y' || chr(10) || '\\)', '\\[ a = ' || l_linenumber || ' \\]', '  unpaired \\[ ' || l_partkey || '  blanks' || chr(9), '```x' || chr(10) || l_partkey || chr(10) || '```', '中文 ' || l_partkey, '<table>' || l_suppkey || '</table>'][(l_partkey + l_linenumber * 5) % 8 + 1] AS content,
 l_linestatus = 'O' AS merge_prev,
 CASE WHEN type IN ({_list(p.CAPTIONS)}) THEN 'caption' WHEN type IN ({_list(p.FOOTNOTES)}) THEN 'footnote' WHEN type IN ({_list(p.DISCARDED)}) THEN 'discarded' WHEN type IN ({_list((p.CONTAINER, *p.VISUAL, *p.CODE))}) THEN 'visual' WHEN type IN ({_list(p.STRUCTURAL)}) THEN 'structural' ELSE 'flow' END AS kind FROM sized),
shared AS (SELECT m.doc, m.page, m.idx, c.idx AS container, m.x0 AS a0, m.y0 AS b0, m.x1 AS a1, m.y1 AS b1, c.x0, c.y0, c.x1, c.y1,
 greatest(0, least(m.x1, c.x1) - greatest(m.x0, c.x0)) * greatest(0, least(m.y1, c.y1) - greatest(m.y0, c.y0)) / ((m.x1 - m.x0) * (m.y1 - m.y0)) AS share
 FROM blocks m JOIN blocks c USING (doc, page) WHERE m.type IN ('image', 'chart') AND c.type = 'image_block'),
inside AS MATERIALIZED (SELECT doc, page, idx, container, list_transform([(a0 - x0) / (x1 - x0), (b0 - y0) / (y1 - y0), (a1 - x0) / (x1 - x0), (b1 - y0) / (y1 - y0)], lambda v: round(least(greatest(v, 0), 1), 3)) AS rel FROM shared WHERE share >= 0.9
 QUALIFY row_number() OVER (PARTITION BY doc, page, idx ORDER BY share DESC, (x1 - x0) * (y1 - y0), container) = 1),
eff AS MATERIALIZED (SELECT b.* FROM blocks b ANTI JOIN inside USING (doc, page, idx)),
reach AS (SELECT ch.doc, ch.page, ch.idx, ch.kind, m.idx AS main, m.type, sqrt(greatest(ch.x0 - m.x1, m.x0 - ch.x1, 0) ** 2 + greatest(ch.y0 - m.y1, m.y0 - ch.y1, 0) ** 2) AS gap,
 sqrt(((ch.x0 + ch.x1 - m.x0 - m.x1) / 2) ** 2 + ((ch.y0 + ch.y1 - m.y0 - m.y1) / 2) ** 2) AS centre
 FROM eff ch JOIN eff m USING (doc, page) WHERE ch.kind IN ('caption', 'footnote') AND m.kind = 'visual' AND (ch.kind = 'caption' OR m.idx < ch.idx)
 AND NOT EXISTS (SELECT 1 FROM eff x WHERE x.doc = ch.doc AND x.page = ch.page AND x.idx > least(ch.idx, m.idx) AND x.idx < greatest(ch.idx, m.idx) AND NOT (x.kind = 'caption' OR (x.kind = 'footnote' AND ch.kind = 'footnote')))),
parents AS MATERIALIZED (SELECT doc, page, idx, kind, CASE WHEN kind = 'footnote' THEN min(main) WHEN max(gap) - min(gap) > 0.003 THEN arg_min(main, gap) WHEN bool_and(type = 'table') THEN max(main)
 WHEN count(*) = 2 AND arg_max(centre, main) < arg_min(centre, main) THEN max(main) ELSE min(main) END AS parent FROM reach GROUP BY doc, page, idx, kind),
items AS MATERIALIZED (SELECT e.doc, e.page, e.idx AS block, CASE WHEN kind IN ('caption', 'footnote') THEN 'flow' ELSE kind END AS kind, CASE WHEN type = 'image_block' THEN 'image' WHEN type IN ({_list(p.CODE)}) THEN 'code' ELSE type END AS type,
 CASE WHEN type IN ({_list(p.CODE)}) THEN type ELSE sub_type END AS sub_type, type = 'image_block' AS is_container, [x0, y0, x1, y1] AS bbox, angle, CASE WHEN kind = 'discarded' THEN {_TIDIED.format("coalesce(content, '')")} ELSE coalesce(content, '') END AS content,
 merge_prev, kind IN ('caption', 'footnote') AS orphan_child,
 (SELECT list({{'block': i.idx, 'text': i.idx || ':' || b.type || ':' || array_to_string(list_transform(i.rel, lambda v: printf('%.3f', v)), ';')}} ORDER BY i.idx) FROM inside i JOIN blocks b USING (doc, page, idx) WHERE i.doc = e.doc AND i.page = e.page AND i.container = e.idx) AS subs,
 (SELECT list({{'block': b.idx, 'text': {_TIDIED.format("coalesce(b.content, '')")}}} ORDER BY b.idx) FROM parents q JOIN blocks b USING (doc, page, idx) WHERE q.doc = e.doc AND q.page = e.page AND q.parent = e.idx AND q.kind = 'caption') AS captions,
 (SELECT list({{'block': b.idx, 'text': {_TIDIED.format("coalesce(b.content, '')")}}} ORDER BY b.idx) FROM parents q JOIN blocks b USING (doc, page, idx) WHERE q.doc = e.doc AND q.page = e.page AND q.parent = e.idx AND q.kind = 'footnote') AS footnotes
 FROM eff e ANTI JOIN parents o ON o.doc = e.doc AND o.page = e.page AND o.idx = e.idx WHERE e.kind <> 'structural')"""

_NAME = "printf('p%03d-b%02d-%s.png', page, block, type)"
_CROPPED = f"{_BLOCKS}, crops AS (SELECT doc, page, block, 'images/' || {_NAME} AS path FROM items WHERE kind = 'visual' AND type IN ('image', 'chart', 'table') AND block % 3 <> 0)"
_BARE = _STRIP.format("content")
_VISUAL = f"""CASE WHEN type = 'code' THEN CASE WHEN {_BARE} = '' THEN '' WHEN starts_with({_BARE}, '```') THEN {_BARE} ELSE '```' || chr(10) || {_BARE} || chr(10) || '```' END
 WHEN type = 'table' THEN CASE WHEN {_BARE} <> '' THEN {_BARE} || coalesce(chr(10) || chr(10) || '<!-- crop: ' || path || ' -->', '') ELSE coalesce('![](' || path || ')', '') END
 ELSE coalesce('![](' || path || ')', '') || CASE WHEN {_BARE} = '' THEN '' ELSE CASE WHEN path IS NULL THEN '' ELSE chr(10) || chr(10) END || '<details>' || chr(10) || '<summary>' || coalesce(nullif(sub_type, ''), CASE type WHEN 'chart' THEN 'chart content' ELSE 'image content' END) || '</summary>' || chr(10) || chr(10) || content || chr(10) || '</details>' END END"""
_FLOW = f"""CASE WHEN {_BARE} = '' THEN '' WHEN type = 'equation' THEN {_DISPLAY.format(_STRIP.format('(' + _PLAIN.format('content') + ')'))} WHEN type IN ({_list(p.TITLES)}) THEN '# ' || {_STRIP.format("regexp_replace(" + _TIDIED.format('content') + r", '\s+', ' ', 'g')")} ELSE {_TIDIED.format('content')} END"""
_RENDERED = f"""{_CROPPED}, bodies AS (SELECT i.*, {_VISUAL} AS body FROM items i LEFT JOIN crops USING (doc, page, block) WHERE kind <> 'discarded'),
texts AS (SELECT doc, page, block, kind, merge_prev, CASE WHEN kind = 'visual' THEN array_to_string(list_transform(list_filter(list_sort([{{'block': block, 'text': body}}] || coalesce(captions, []) || coalesce(footnotes, [])), lambda s: {_STRIP.format('s.text')} <> ''), lambda s: s.text), chr(10) || chr(10)) ELSE {_FLOW} END AS text FROM bodies),
gaps AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN kind <> 'flow' OR NOT merge_prev THEN chr(10) || chr(10) WHEN regexp_matches(text, '[一-鿿]') THEN '' ELSE ' ' END AS gap FROM texts WHERE {_STRIP.format('text')} <> '' WINDOW w AS (PARTITION BY doc ORDER BY page, block))"""


def _joined(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(x["block"].cast("string"), F.lit(":"), x["text"])), "|")


def _items(spark, sf_dir) -> DataFrame:
    return p.assembled_items(page_blocks(spark, sf_dir))


def _crops(items: DataFrame) -> DataFrame:
    """A path for two of three pictures of the plan."""
    return p.crop_plan(items).filter("block % 3 <> 0").select("doc", "page", "block", F.concat(F.lit("images/"), "name").alias("path"))


def _subs(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["block"].cast("string"), x["type"], F.array_join(F.transform(x["bbox_in_parent"], lambda v: F.format_string("%.3f", v)), ";"))), "|")


def dc6(spark, sf_dir):
    items = _items(spark, sf_dir).withColumns({c: _joined(c) for c in ("captions", "footnotes")}).withColumns({"sub_images": _subs("sub_images"), "bbox": F.array_join(F.transform("bbox", lambda v: F.format_string("%.5f", v)), ";")})
    return items.select("doc", "page", "block", "kind", "type", "sub_type", "is_container", "bbox", "angle", F.md5("content").alias("content"), "merge_prev", "orphan_child", "sub_images", F.md5("captions").alias("captions"), F.md5("footnotes").alias("footnotes"))


_LISTED = "coalesce(array_to_string(list_transform({0}, lambda x: x.block || ':' || x.text), '|'), '')"
_DC6 = f"""WITH {_BLOCKS} SELECT doc, page, block, kind, type, sub_type, is_container, array_to_string(list_transform(bbox, lambda v: printf('%.5f', v)), ';') AS bbox, angle, md5(content) AS content, merge_prev, orphan_child,
coalesce(array_to_string(list_transform(subs, lambda x: x.text), '|'), '') AS sub_images, md5({_LISTED.format('captions')}) AS captions, md5({_LISTED.format('footnotes')}) AS footnotes FROM items"""


def dc6_pages(spark, sf_dir):
    pages = p.assemble(page_blocks(spark, sf_dir))
    of = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["block"].cast("string"), x["type"])), "|")
    owned = F.aggregate("items", F.lit(0), lambda n, x: n + F.size(x["captions"]) + F.size(x["footnotes"]) + F.size(x["sub_images"]))
    return pages.select("doc", "page", F.size("items").cast("long").alias("n_items"), F.size("discarded").cast("long").alias("n_discarded"), owned.cast("long").alias("n_owned"), of("items").alias("items"), of("discarded").alias("discarded"))


_DC6_PAGES = f"""WITH {_BLOCKS} SELECT doc, page, count(*) FILTER (kind <> 'discarded') AS n_items, count(*) FILTER (kind = 'discarded') AS n_discarded, sum(coalesce(len(captions), 0) + coalesce(len(footnotes), 0) + coalesce(len(subs), 0))::BIGINT AS n_owned,
coalesce(string_agg(block || ':' || type, '|' ORDER BY block) FILTER (kind <> 'discarded'), '') AS items, coalesce(string_agg(block || ':' || type, '|' ORDER BY block) FILTER (kind = 'discarded'), '') AS discarded FROM items GROUP BY doc, page"""


def dc7_markdown(spark, sf_dir):
    items = _items(spark, sf_dir)
    return p.to_markdown(items, _crops(items)).select("doc", F.char_length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("md5"))


def dc7_places(spark, sf_dir):
    items = _items(spark, sf_dir)
    return p.placed_markdown(items, _crops(items)).select("doc", "page", "block", F.col("start").cast("long").alias("start"), F.md5("text").alias("md5"))


def dc7_content_list(spark, sf_dir):
    items = _items(spark, sf_dir)
    rows = p.to_content_list(items, _crops(items))
    whole = lambda c: F.md5(F.array_join(F.col(c), "|"))
    return rows.select("doc", "page_idx", "block", "type", F.md5("text").alias("text"), "text_level", "text_format", F.array_join(F.transform("bbox", lambda v: F.format_string("%.4f", v)), ";").alias("bbox"), "img_path", whole("captions").alias("captions"), whole("footnotes").alias("footnotes"), F.md5("body").alias("body"), "sub_type", _subs("sub_images").alias("sub_images"))


_TEXTS = "md5(coalesce(array_to_string(list_transform({0}, lambda x: x.text), '|'), ''))"
_CONTENT_LIST = f"""WITH {_CROPPED} SELECT doc, page - 1 AS page_idx, block, CASE WHEN kind = 'flow' AND type IN ({_list(p.TITLES)}) THEN 'text' ELSE type END AS type,
md5(CASE WHEN kind = 'visual' THEN NULL WHEN type = 'equation' THEN {_DISPLAY.format(_BARE)} ELSE {_TIDIED.format('content')} END) AS text, CASE WHEN kind = 'flow' AND type IN ({_list(p.TITLES)}) THEN 1 END AS text_level, CASE WHEN kind = 'flow' AND type = 'equation' THEN 'latex' END AS text_format,
array_to_string(list_transform(bbox, lambda v: printf('%.4f', round(v, 4))), ';') AS bbox, CASE WHEN kind = 'visual' AND type <> 'code' THEN coalesce(path, '') END AS img_path, CASE WHEN kind = 'visual' THEN {_TEXTS.format('captions')} END AS captions, CASE WHEN kind = 'visual' THEN {_TEXTS.format('footnotes')} END AS footnotes,
CASE WHEN kind = 'visual' THEN md5(content) END AS body, CASE WHEN kind = 'visual' THEN nullif(sub_type, '') END AS sub_type, array_to_string(list_transform(subs, lambda x: x.text), '|') AS sub_images
FROM items LEFT JOIN crops USING (doc, page, block) WHERE kind <> 'discarded' AND (kind = 'visual' OR {_BARE} <> '')"""

QUERIES = {
    "dc6_page_items": (dc6, _DC6),
    "dc6_assembled_pages": (dc6_pages, _DC6_PAGES),
    "dc7_crop_plan": (lambda s, d: p.crop_plan(_items(s, d)).select("doc", "page", "block", "type", F.array_join(F.transform("bbox", lambda v: F.format_string("%.5f", v)), ";").alias("bbox"), "angle", "name"), f"WITH {_BLOCKS} SELECT doc, page, block, type, array_to_string(list_transform(bbox, lambda v: printf('%.5f', v)), ';') AS bbox, angle, {_NAME} AS name FROM items WHERE kind = 'visual' AND type IN ('image', 'chart', 'table')"),
    "dc7_markdown": (dc7_markdown, f"WITH {_RENDERED} SELECT doc, length(string_agg(gap || text, '' ORDER BY page, block)) + 1 AS n_chars, md5(string_agg(gap || text, '' ORDER BY page, block) || chr(10)) AS md5 FROM gaps GROUP BY doc"),
    "dc7_places": (dc7_places, f"WITH {_RENDERED} SELECT doc, page, block, (sum(length(gap) + length(text)) OVER (PARTITION BY doc ORDER BY page, block) - length(text))::BIGINT AS start, md5(text) AS md5 FROM gaps"),
    "dc7_content_list": (dc7_content_list, _CONTENT_LIST),
}
