"""Pages put together: a plain loop over random pages with nested containers, orphans and ties, and golden renderings."""

from __future__ import annotations

import math
import random

import pytest

from quillmesh.operators import pages as p

SCHEMA = "doc long, page int, idx int, type string, sub_type string, x0 double, y0 double, x1 double, y1 double, angle int, content string, merge_prev boolean"
KINDS = {**dict.fromkeys(p.CAPTIONS, "caption"), **dict.fromkeys(p.FOOTNOTES, "footnote"), **dict.fromkeys(p.DISCARDED, "discarded"), **dict.fromkeys((p.CONTAINER, *p.VISUAL, *p.CODE), "visual"), **dict.fromkeys(p.STRUCTURAL, "structural")}


def row(page, idx, kind, box=(0.0, 0.0, 0.1, 0.1), content="x", sub=None, merge=False, doc=1):
    return (doc, page, idx, kind, sub, *map(float, box), None, content, merge)


def plain(blocks):
    """(items with their parts, orphans) of one page, block after block."""
    kind = {b[2]: KINDS.get(b[3], "flow") for b in blocks}
    box = {b[2]: b[5:9] for b in blocks}
    types = {b[2]: b[3] for b in blocks}
    area = lambda x: max(0, x[2] - x[0]) * max(0, x[3] - x[1])
    parent, subs = {}, {}
    for b in blocks:
        if b[3] in ("image", "chart"):
            best = None
            for c in blocks:
                if c[3] == "image_block" and area(box[b[2]]):
                    both = [max(box[b[2]][0], box[c[2]][0]), max(box[b[2]][1], box[c[2]][1]), min(box[b[2]][2], box[c[2]][2]), min(box[b[2]][3], box[c[2]][3])]
                    share = area(both) / area(box[b[2]])
                    if share >= 0.9:
                        best = min(best or (2,), (-share, area(box[c[2]]), c[2]))
            if best:
                subs[b[2]] = best[2]
    seq = [b[2] for b in blocks if b[2] not in subs]
    for at, i in enumerate(seq):
        if kind[i] not in ("caption", "footnote"):
            continue
        skip = {"caption"} if kind[i] == "caption" else {"caption", "footnote"}
        found = []
        for step in (-1, 1) if kind[i] == "caption" else (-1,):
            k = at + step
            while 0 <= k < len(seq) and kind[seq[k]] in skip:
                k += step
            if 0 <= k < len(seq) and kind[seq[k]] == "visual":
                found.append(seq[k])
        gap = {m: math.hypot(max(box[i][0] - box[m][2], box[m][0] - box[i][2], 0), max(box[i][1] - box[m][3], box[m][1] - box[i][3], 0)) for m in found}
        mid = {m: math.hypot((box[i][0] + box[i][2] - box[m][0] - box[m][2]) / 2, (box[i][1] + box[i][3] - box[m][1] - box[m][3]) / 2) for m in found}
        if len(found) == 1:
            parent[i] = found[0]
        elif found:
            if abs(gap[found[0]] - gap[found[1]]) > p.EDGE_TOLERANCE:
                parent[i] = min(found, key=lambda m: (gap[m], m))
            elif all(types[m] == "table" for m in found):
                parent[i] = max(found)
            else:
                parent[i] = min(found, key=lambda m: (mid[m], m))
    items = {}
    for i in seq:
        if i not in parent and kind[i] != "structural":
            own = lambda k, i=i: sorted(c for c, m in parent.items() if m == i and kind[c] == k)
            items[i] = (own("caption"), own("footnote"), sorted(s for s, c in subs.items() if c == i), kind[i] in ("caption", "footnote"))
    return items


@pytest.mark.parametrize("scale", [1.0, 1000.0])
def test_random_pages_are_a_plain_loop(spark, scale):
    rng = random.Random(int(scale))
    kinds = ["image_block", "image_block", "image_block", "image", "image", "image", "chart", "table", "table", "image_caption", "caption", "table_caption", "footnote", "image_footnote", "text", "header", "list", "code", None, "title"]
    rows = []
    for page in range(60):
        for idx in range(rng.randint(1, 24)):
            kind = rng.choice(kinds)
            x, y, w, h = (rng.randrange(8) / 8 * scale for _ in range(4))
            box = (x, y, x + (w + 0.7 * scale if kind == "image_block" else w / 6), y + (h + 0.7 * scale if kind == "image_block" else h / 6))
            rows.append(row(page, idx, kind, box))
    got = {}
    for r in p.assembled_items(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        got.setdefault(r.page, {})[r.block] = ([c.block for c in r.captions], [c.block for c in r.footnotes], [s.block for s in r.sub_images], r.orphan_child)
    want = {page: plain([r for r in rows if r[1] == page]) for page in range(60)}
    want = {k: v for k, v in want.items() if v}
    assert set(got) == set(want)
    for page in want:
        assert got[page] == want[page], [r for r in rows if r[1] == page]
    parts = [i for w in want.values() for i in w.values()]
    assert sum(bool(i[2]) for i in parts) > 5 and sum(i[3] for i in parts) > 10 and sum(bool(i[0]) for i in parts) > 20


def figure_page():
    return [
        row(1, 0, "header", content="Head \\(x\\)"),
        row(1, 1, "title", content="A  title\n\\( n \\)"),
        row(1, 2, "text", content="First part"),
        row(1, 3, "image_block", (0, 0, 0.5, 0.5), None, "panels"),
        row(1, 4, "image", (0, 0, 0.25, 0.5), "lost"),
        row(1, 5, "chart", (0.25, 0, 0.5, 0.5), "lost"),
        row(1, 6, "image_caption", (0, 0.5, 0.5, 0.6), "Figure 1: \\[2\\]"),
        row(1, 7, "image_footnote", (0, 0.6, 0.5, 0.7), "a note"),
        row(1, 8, "text", content="goes on", merge=True),
        row(2, 0, "text", content="and on", merge=True),
        row(2, 1, "equation", content="\\[ a = b \\]"),
        row(2, 2, "table_caption", (0, 0, 1, 0.1), "Table 1"),
        row(2, 3, "table", (0, 0.1, 1, 0.3), " <table></table> "),
        row(2, 4, "algorithm", content="step"),
        row(2, 5, "text", content="中文", merge=True),
        row(2, 6, "list", content="gone"),
    ]


def test_renderings(spark):
    items = p.assembled_items(spark.createDataFrame(figure_page(), SCHEMA)).cache()
    crops = p.crop_plan(items).selectExpr("doc", "page", "block", "concat('i/', name) AS path")
    assert [(r.page, r.block, r.path) for r in crops.orderBy("page", "block").collect()] == [(1, 3, "i/p001-b03-image.png"), (2, 3, "i/p002-b03-table.png")]
    text = p.to_markdown(items, crops).first().markdown
    assert text == "# A title $n$\n\nFirst part\n\n![](i/p001-b03-image.png)\n\nFigure 1: [2]\n\na note goes on and on\n\n$$\n[ a = b ]\n$$\n\nTable 1\n\n<table></table>\n\n<!-- crop: i/p002-b03-table.png -->\n\n```\nstep\n```中文\n"
    for r in p.placed_markdown(items, crops).collect():
        assert text[r.start : r.start + len(r.text)] == r.text
    entries = {(r.page_idx, r.block): r for r in p.to_content_list(items, crops).collect()}
    assert sorted(entries) == [(0, 1), (0, 2), (0, 3), (0, 8), (1, 0), (1, 1), (1, 3), (1, 4), (1, 5)]
    figure, code, formula = entries[0, 3], entries[1, 4], entries[1, 1]
    assert (figure.type, figure.captions, figure.footnotes, figure.sub_type, figure.body) == ("image", ["Figure 1: [2]"], ["a note"], "panels", "")
    assert [(s.block, s.type, s.bbox_in_parent) for s in figure.sub_images] == [(4, "image", [0.0, 0.0, 0.5, 1.0]), (5, "chart", [0.5, 0.0, 1.0, 1.0])]
    assert (code.type, code.sub_type, code.img_path, code.body) == ("code", "algorithm", None, "step")
    assert (formula.text, formula.text_format, formula.captions) == ("$$\na = b\n$$", "latex", None)
    assert (entries[0, 1].type, entries[0, 1].text_level) == ("text", 1)


def test_nested_pages(spark):
    pages = {r.page: r for r in p.assemble(spark.createDataFrame(figure_page(), SCHEMA)).collect()}
    assert [i.block for i in pages[1]["items"]] == [1, 2, 3, 8] and [(d.block, d.content) for d in pages[1].discarded] == [(0, "Head $x$")]
    assert [s.block for s in pages[1]["items"][2].sub_images] == [4, 5] and not pages[2].discarded
    assert p.assemble(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_page_is_compared_with_itself(spark):
    """A page of 20,000 images and containers: pairs meet in cells, and captions see their neighbours in one pass."""
    rows = [row(1, i, ("image_block", "image", "caption")[i % 3], ((i // 3) % 100, i // 300, (i // 3) % 100 + 0.9, i // 300 + 0.9)) for i in range(30_000)]
    items = p.assembled_items(spark.createDataFrame(rows, SCHEMA))
    assert items.filter("size(sub_images) = 1 and size(captions) >= 1").count() == 10_000


def test_blocks_are_shuffled_once_by_page(spark):
    plan = p.assemble(spark.createDataFrame(figure_page(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
