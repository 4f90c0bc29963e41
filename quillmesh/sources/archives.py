"""SC9: archives of papers as rows of files. Spark lists and reads the archives, wherever they are; members are streamed."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from posixpath import normpath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = (".tex", ".bib", ".bbl", ".json")
MEMBER = "package string, name string, size long, content string, error string"
#: Characters of members that leave a task together.
BATCH_CHARS = 4_000_000


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def safe_name(name: str) -> str | None:
    """The name of a member below its archive; None where it leads out."""
    path = normpath(name.lstrip("/"))
    return None if path == ".." or path.startswith("../") else path


def members(package: str, data: bytes, suffixes: tuple[str, ...]):
    """(package, name, size, content, error) of each file of an archive; content of names with these suffixes alone. What is broken ends with a row of its error."""
    try:
        if data[:2] == b"\x1f\x8b" and not tarfile.is_tarfile(io.BytesIO(data)):
            whole = gzip.decompress(data)  # one file without a name of its own
            yield package, f"{package}.tex", len(whole), _text(whole), None
            return
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as archive:
            for member in archive:
                if not member.isfile():
                    continue
                name = safe_name(member.name)
                if name is None:
                    yield package, member.name, member.size, None, "name leads out of the archive"
                    continue
                wanted = name.lower().endswith(suffixes)
                yield package, name, member.size, _text(archive.extractfile(member).read()) if wanted else None, None
    except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
        yield package, None, None, None, f"{type(e).__name__}: {e}"


def _opened(suffixes: tuple[str, ...]):
    names = [c.split()[0] for c in MEMBER.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        for b in batches:
            for package, data in zip(b.column("package").to_pylist(), b.column("content"), strict=True):
                held, size = [], 0
                for row in members(package, data.as_buffer().to_pybytes(), suffixes):
                    held.append(row)
                    size += len(row[3] or "")
                    if size > BATCH_CHARS:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return run


def read_archives(spark: SparkSession, path: str, glob: str = "*.gz", suffixes: tuple[str, ...] = TEXTS) -> DataFrame:
    """(package, name, size, content, error) of the files in the archives below a path; the package is the archive's name before .tar.gz, .tgz or .gz.

    Content is read for names with these suffixes, and is null for others. An archive that cannot be read to its end gives
    what came before and a row with its error; it does not stop the others. A tar of no files has no rows. Archives of 2 GB and more are
    beyond Spark's reader of whole files.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(tar\.gz|tgz|gz|tar)$", "")
    return found.select(name.alias("package"), "content").mapInArrow(_opened(suffixes), MEMBER)
