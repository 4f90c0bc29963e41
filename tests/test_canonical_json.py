"""Canonical JSON equals what Python writes with sorted names, and hashes follow the content alone."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import json_text as js


def test_equal_to_sorted_dumps(spark):
    kind = "z bigint, a string, `B c` boolean, m map<string,array<int>>, s struct<y:string,x:array<struct<q:int,p:string>>>, d decimal(10,2)"
    rows = [
        (1, 'é "q" \\ / \n\t\x1f ', True, {"b": [1, None], "a": [], "B": None}, ("v", [(1, "p"), None, (None, None)]), Decimal("1.50")),
        (None, None, None, None, None, None),
        (-5, "", False, {}, (None, []), Decimal("-2.00")),
    ]
    df = spark.createDataFrame(rows, kind)
    whole = F.struct("*")
    got = [tuple(r) for r in df.select(js.canonical_json(whole, df.schema), js.payload_hash(whole, df.schema)).collect()]
    for (text, digest), row in zip(got, df.collect(), strict=True):
        plain = row.asDict(recursive=True)
        plain["d"] = "D" if plain["d"] is not None else None
        expected = json.dumps(plain, sort_keys=True, ensure_ascii=False)
        expected = expected.replace('"D"', str(row.d)) if row.d is not None else expected
        assert text.lower() == expected.lower()  # of control characters the digits may be capital
        assert digest == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(TypeError, match="floating"):
        js.canonical_json(F.lit(1.5), spark.createDataFrame([], "x double").schema["x"].dataType)
