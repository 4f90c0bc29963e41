"""Archives as rows: tar.gz, plain gz, broken and unsafe ones, and the main file by hint."""

from __future__ import annotations

import gzip
import io
import tarfile

from quillmesh.operators import packages
from quillmesh.sources.archives import read_archives


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives_of_every_kind(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    whole = tar([("./main.tex", b"\\documentclass{x}\\input{b}"), ("a/b.tex", "é".encode("latin-1")), ("fig.png", b"\x00\x01"), ("00README.json", b'{"sources": [{"usage": "toplevel", "filename": "b.tex"}]}'), ("../evil.tex", b"x")])
    (tmp_path / "p1.tar.gz").write_bytes(whole)
    (tmp_path / "sub" / "p2.gz").write_bytes(gzip.compress("\\title{Né}".encode()))
    (tmp_path / "p3.tar.gz").write_bytes(tar([(f"{i}.tex", b"x" * 5000 + bytes(str(i), "ascii")) for i in range(40)])[:-200])
    (tmp_path / "p4.tgz.gz").write_bytes(b"\x1f\x8bnot really")
    (tmp_path / "p5.tar.gz").write_bytes(tar([]))
    (tmp_path / "other.txt").write_bytes(b"no archive")
    rows = read_archives(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.package, []).append(r)
    assert set(by) == {"p1", "p2", "p3", "p4.tgz"}
    assert {(r.name, r.content, r.error) for r in by["p1"] if r.name != "00README.json"} == {("main.tex", "\\documentclass{x}\\input{b}", None), ("a/b.tex", "é", None), ("fig.png", None, None), ("../evil.tex", None, "name leads out of the archive")}
    assert [(r.name, r.content) for r in by["p2"]] == [("p2.tex", "\\title{Né}")]
    assert by["p3"][-1].error and by["p4.tgz"][-1].error and by["p4.tgz"][-1].name is None
    files = read_archives(spark, str(tmp_path)).filter("error is null").select("package", "name", "content")
    got = {r.package: (r.main, r.source) for r in packages.assembled(files).collect()}
    assert got["p1"] == ("a/b.tex", "é") and got["p2"] == ("p2.tex", "\\title{Né}")
    assert read_archives(spark, str(tmp_path), glob="*.none").collect() == []
