"""Golden papers and pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import formatting as f

PAPERS = "paper int, arxiv_id string, version string, title string, authors array<string>, abstract string, tokens string"
SECTIONS = "paper int, pos int, depth int, level int, title string, markdown string, anchor string"


def test_papers(spark):
    papers = spark.createDataFrame([(1, "2001.1", "v2", 'A "b" \\', ["X Y", "Z"], " abs ", "1.2k"), (2, "2001.2", None, "", [], None, None)], PAPERS)
    sections = spark.createDataFrame([(1, 2, 1, 8, "Sub", "", 'S1.1&"'), (1, 1, 0, 2, "Intro", "text", None), (1, 3, 0, 2, "End", None, "")], SECTIONS)
    got = {r.paper: r for r in f.format_papers(papers, sections).collect()}
    one, two = got[1], got[2]
    assert one.summary == 'Title: A "b" \\\nArXiv: 2001.1\nVersion: v2\nAuthors: X Y, Z\nSections: 3\nEstimated tokens: 1.2k'
    assert one.tree == "Sections:\nAbstract\nIntro\n    Sub\nEnd"
    assert one.content == '## Contents\n- Intro\n  - Sub\n- End\n\n## Abstract\n\nabs\n\n## Intro\n\ntext\n\n<a id="S1.1&amp;&quot;" name="S1.1&amp;&quot;"></a>\n###### Sub\n\n## End'
    assert one.header == '---\ntitle: "A \\"b\\" \\\\"\nversion: "v2"\nauthors: ["X Y", "Z"]\nurl: "https://arxiv.org/abs/2001.1"\nsections: 3\nestimated_tokens: "1.2k"\n---'
    assert (two.summary, two.tree, two.content) == ("ArXiv: 2001.2\nSections: 0", "Sections:\nAbstract\n", "")
    assert f.format_papers(papers, sections, toc=False, abstract_in_tree=False).filter("paper = 1").first().tree == "Sections:\nIntro\n    Sub\nEnd"


def test_pictures(spark):
    urls = ["http://h/a.png", "http://h/x/a.png?q", "http://h/a-2.png", "http://h/a.png", "http://g/a.png/", "https://h/", "https://h/b c%.tar.gz", "http://h/.png", "http://k/.png", "http://h/é", "http://i/é"]
    text = " ".join(f"![al\\]t {i}]({u})" for i, u in enumerate(urls) if " " not in u) + " [no](http://h/a.png) ![l](local.png)"
    row = spark.createDataFrame([(urls, text), ([], None)], "urls array<string>, text string").select(f.image_names(F.col("urls")).alias("n"), f.remote_images(F.col("text")).alias("r"), f.localized(F.col("text"), f.image_names(f.remote_images(F.col("text"))), "im$g").alias("l")).collect()
    assert [x.name for x in row[0].n] == ["a.png", "a-2.png", "a-2-2.png", "a-3.png", "h", "b_c_.tar.gz", ".png", ".png-2", "é", "é-2"]
    assert row[0].r == [u for u in urls if " " not in u] and row[1].r == [] and row[1].n == [] and row[1].l is None
    assert row[0].l.startswith("![al\\]t 0](im$g/a.png) ![al\\]t 1](im$g/a-2.png)") and row[0].l.endswith("[no](http://h/a.png) ![l](local.png)")
