"""SK3: records as YAML, and records as files of their own names that all appear at once or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillmesh.sources.archives import safe_name

#: The folder of files that are being written.
HALVES = ".halves"
_WORD = r"^[A-Za-z_][A-Za-z0-9_-]*$"
#: Words that YAML reads as something else than a text, so that keys of these names are quoted.
_TAKEN = ("true", "false", "null", "yes", "no", "on", "off", "y", "n")


def _quoted(c: Column) -> Column:
    """A text in double quotes, as JSON and YAML both read it."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _key(c: Column) -> Column:
    return F.when(c.rlike(_WORD) & ~F.lower(c).isin(*_TAKEN), c).otherwise(_quoted(c))


def yaml_value(c: Column, kind: T.DataType, indent: int = 0) -> Column:
    """What stands after a key or a dash: a blank and a plain value, or lines of their own in block style; from expressions alone.

    Texts, times and binary (as base 64) are quoted, so that nothing is read as another type; null is null, and empty lists and mappings are [] and {}.
    """
    pad = "\n" + " " * indent
    if isinstance(kind, T.StructType):
        lines = [F.concat(F.lit(pad), _key(F.lit(f.name)), F.lit(":"), yaml_value(c[f.name], f.dataType, indent + 2)) for f in kind.fields]
        text = F.concat(*lines) if lines else F.lit(" {}")
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: F.concat(F.lit(pad + "-"), yaml_value(x, kind.elementType, indent + 2)))
        text = F.when(F.size(c) == 0, " []").otherwise(F.array_join(items, ""))
    elif isinstance(kind, T.MapType):
        items = F.transform(F.map_entries(c), lambda e: F.concat(F.lit(pad), _key(e["key"].cast("string")), F.lit(":"), yaml_value(e["value"], kind.valueType, indent + 2)))
        text = F.when(F.size(c) == 0, " {}").otherwise(F.array_join(items, ""))
    elif isinstance(kind, T.FloatType | T.DoubleType):
        text = F.concat(F.lit(" "), F.when(F.isnan(c), ".nan").when(c == float("inf"), ".inf").when(c == float("-inf"), "-.inf").otherwise(c.cast("string")))
    elif isinstance(kind, T.NumericType | T.BooleanType):
        text = F.concat(F.lit(" "), c.cast("string"))
    else:
        text = F.concat(F.lit(" "), _quoted(F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")))
    return F.when(c.isNull(), " null").otherwise(text)


def yaml_records(df: DataFrame) -> DataFrame:
    """One YAML list item a row, all columns in their order; the rows of all parts together are one list."""
    return df.select(F.concat(F.lit("-"), yaml_value(F.struct("*"), df.schema, 2)).alias("value"))


def write_yaml(df: DataFrame, path: str) -> None:
    """SK3: the rows as a YAML list; Spark's committer renames finished parts only, so a failed task leaves none."""
    yaml_records(df).write.text(path)


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _FileWriter(DataSourceArrowWriter):
    """Writes into a folder beside the target, which takes the target's name once all tasks are done."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staged = f"{self.path}.part-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.staged)
        system.create_dir(f"{root}/{HALVES}", recursive=True)
        made, last, n = "", None, 0
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                place = safe_name(name) if name else None
                if place is None or place == "." or name.endswith("/"):
                    raise ValueError(f"no name for a file: {name!r}")
                if place == last:
                    raise ValueError(f"two records of one name: {name!r}")
                folder = place.rpartition("/")[0]
                if folder != made:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    made = folder
                # an attempt that is lost halfway, or runs twice, never leaves half a file under the name
                half = f"{root}/{HALVES}/{uuid.uuid4().hex}"
                with system.open_output_stream(half) as out:
                    out.write((content or "").encode())
                system.move(half, f"{root}/{place}")
                last, n = place, n + 1
        return _Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, staged = fs.FileSystem.from_uri(self.staged)
        _, target = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{staged}/{HALVES}", recursive=True)
        system.delete_dir(f"{staged}/{HALVES}")
        system.move(staged, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, staged = fs.FileSystem.from_uri(self.staged)
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


class RecordFiles(DataSource):
    """The data source `record_files`, for writing (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        path = self.options["path"]
        system, root = fs.FileSystem.from_uri(path)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        return _FileWriter(path)


def write_files(files: DataFrame, path: str) -> None:
    """SK3: each row of files(name, content) as a file below path, a URI; names may have folders.

    All files appear at once, by the rename of one folder, or none: a failed job removes what it has written. An empty table makes an
    empty folder, null contents are empty files. A path that exists, a name that is null, empty or leads out, and two rows of one
    name are errors. Where a store cannot rename folders, its rename is a copy and takes longer.
    """
    files.sparkSession.dataSource.register(RecordFiles)
    rows = files.select("name", "content").repartition("name").sortWithinPartitions("name")
    rows.write.format("record_files").mode("append").option("path", path).save()
