"""Folders of papers below a root, from a real tree and from listings."""

from __future__ import annotations

from quillmesh.sources import folders


def found(df):
    return {(r.folder, r.paper_id, r.content_list, r.markdown) for r in folders.paper_folders(df).collect()}


def tree(path, *names):
    for n in names:
        (path / n).parent.mkdir(parents=True, exist_ok=True)
        (path / n).write_text("x")


def test_each_kind_of_root(spark, tmp_path):
    tree(tmp_path / "many+x", "p1/vlm/p1.md", "p1/vlm/a.md", "p1/vlm/z_content_list.json", "p1/vlm/b_content_list.json", "p2/vlm/other.png", "p3/auto/p3.md", "deep/p4/vlm/p4.md")
    tree(tmp_path / "one", "vlm/x.md", "vlm/one_content_list.json", "vlm/sub/y.md", "q/vlm/q.md", "top.md")
    tree(tmp_path / "own", "k_content_list.json", "q/vlm/q.md")
    get = lambda name: found(folders.listed(spark, str(tmp_path / name)))
    assert get("many+x") == {("p1/vlm", "p1", "b_content_list.json", "p1.md"), ("p2/vlm", "p2", None, None)}
    assert get("one") == {("vlm", "one", "one_content_list.json", "x.md")}
    assert get("own") == {("", tmp_path.name, "k_content_list.json", None)}


def test_listings_with_gaps(spark):
    rows = [("/a/r", "vlm/deeper/x.md"), ("/a/s", "readme.txt"), (None, "vlm/x.md"), ("/a/t", None), ("r", "x.md"), ("r", "x.md")]
    assert found(spark.createDataFrame(rows, "root string, path string")) == {("", "", None, "x.md")}
    assert found(spark.createDataFrame([], "root string, path string")) == set()
