"""Strings inside arbitrary JSON, and JSON inside free text: small helpers of Arrow batches, where no built-in function recurses."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def walk(value, captions_only: bool, inside: bool = False) -> Iterator[str]:
    """All strings of a JSON value in order; or those under keys that speak of captions or footnotes."""
    if isinstance(value, str):
        if inside or not captions_only:
            yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, captions_only, inside or "caption" in k.lower() or "footnote" in k.lower())
    elif isinstance(value, list):
        for v in value:
            yield from walk(v, captions_only, inside)


def strings_of(text: Column, captions_only: bool = False) -> Column:
    """JS1: the strings of a JSON text; null where it is none."""

    def of(s: str | None):
        try:
            return None if s is None else list(walk(json.loads(s), captions_only))
        except ValueError:
            return None

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(of)

    return run(text)


def first_object(text: str | None, keys: tuple[str, ...]) -> str | None:
    """The first JSON object in a text that has all the keys, compact."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            if all(k in value for k in keys):
                return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        except json.JSONDecodeError:
            pass
        at = text.find("{", at + 1)
    return None


def json_object_in(text: Column, keys: tuple[str, ...]) -> Column:
    """JS3: the first JSON object with these keys in free text; texts without a brace never reach Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: first_object(x, keys))

    return run(F.when(F.contains(text, F.lit("{")), text))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """HA1: a value as JSON that depends on its content alone: names sorted, `, ` and `: ` between, nulls written.

    Structs are sorted by their fields' names, maps by their keys; numbers are whole or decimal ones, as floating ones have no one text.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        pairs = [F.concat(_text(F.lit(f.name)), F.lit(": "), canonical_json(c[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        keyed = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical_json(e["value"], kind.valueType).alias("v"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(keyed, lambda e: F.concat(_text(e["k"]), F.lit(": "), e["v"])), ", "), F.lit("}"))
    elif isinstance(kind, T.FloatType | T.DoubleType):
        raise TypeError("floating numbers have no canonical text: cast them to decimals or texts")
    elif isinstance(kind, T.NumericType | T.BooleanType):
        text = c.cast("string")
    else:
        text = _text(c.cast("string"))
    return F.when(c.isNull(), "null").otherwise(text)


def _text(c: Column) -> Column:
    listed = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def payload_hash(c: Column, kind: T.DataType) -> Column:
    """HA1: the SHA-256 of a value's canonical JSON."""
    return F.sha2(F.encode(canonical_json(c, kind), "UTF-8"), 256)
