"""Sharding by rendezvous hashing: every key draws a weighted number for each shard and goes where it is largest.

Shard i scores -weight / ln(u), with u from a hash of the key and i alone. A further shard draws numbers of its own and
changes none of the others, so it takes rows only into itself, a share that follows its weight; without one, only its own
rows move. All is column expressions. Places within a shard are running counts over ranges of its rows (a shard of any
size is numbered by many tasks), with a number of the written row as the last order, so that repeated rows part as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import materialize
from quillmesh.llm.mixing import running_sums

SHARDS = 40
MOST_SHARDS = 1 << 16


def drawn(key: Column, shard: int) -> Column:
    """47 bits of the number that a key draws for a shard, and the shard below them, so that ties go to the lower shard."""
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("long")), 17)
    return F.shiftleft(h, 16).bitwiseOR(F.lit(MOST_SHARDS - 1 - shard).cast("long"))


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of largest -weight / ln(u). Among shards of one weight that is the largest u, so a row costs one logarithm a distinct weight, and none if all are equal."""
    groups: dict[float, list[int]] = {}
    for i, w in enumerate(weights):
        if w > 0:
            groups.setdefault(float(w), []).append(i)
    tops = {w: F.greatest(*[drawn(key, i) for i in own]) if len(own) > 1 else drawn(key, own[0]) for w, own in groups.items()}
    shard = {w: (F.lit(MOST_SHARDS - 1) - top.bitwiseAND(F.lit(MOST_SHARDS - 1).cast("long"))).cast("int") for w, top in tops.items()}
    if len(groups) == 1:
        return next(iter(shard.values()))
    score = {w: F.lit(-w) / F.log((F.shiftrightunsigned(top, 16).cast("double") + 0.5) / float(1 << 47)) for w, top in tops.items()}
    return -F.greatest(*[F.struct(score[w].alias("score"), (-shard[w]).alias("less")) for w in groups]).getField("less")


def with_shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, keys: Sequence[str] = ("doc_id",), grown_by: float = 1.0) -> DataFrame:
    """docs with shard, an int from 0, and grown_shard, its shard if one of weight `grown_by` joined. No row is shuffled.

    The columns `keys` and the weights decide alone: rows with equal keys share a shard, whatever their texts; a null is a
    value like any other. Weights are not negative, and one at least is positive. Columns of docs with these two names are
    replaced, others stay, whatever their names. An empty table gives an empty one.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0 or grown_by < 0 or len(weights) >= MOST_SHARDS:
        raise ValueError(f"weights are fewer than {MOST_SHARDS} numbers of 0 or more, one at least above 0")
    row = docs.select(F.struct("*").alias("row"), F.xxhash64(*[F.col(k) for k in keys]).alias("key"))
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "grown_shard")]
    return row.select(*others, best_shard(F.col("key"), weights).alias("shard"), best_shard(F.col("key"), [*weights, grown_by]).alias("grown_shard"))


def with_slot(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with slot, a long: the place of each row in its shard, from 0 without gaps, by the columns `order`.

    Rows equal in all of these stand next to each other in any order. A column named slot is replaced. Give it slim rows: they
    are written and shuffled twice.
    """
    own = [c for c in rows.columns if c != "slot"]
    table = materialize(rows.select("shard", F.struct(*order).alias("place"), F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("nth")), "sharded")
    done = running_sums(table.withColumn("one", F.lit(1)), ["shard"], [F.col("place"), F.col("nth")], ["one"])
    return done.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("before_one").cast("long").alias("slot"))


def moves(docs: DataFrame, before: Sequence[float], after: Sequence[float], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(from_shard, to_shard, n): how many rows each change of weights would carry where; shards keep their numbers."""
    old = with_shard(docs.select(*keys), before, keys).withColumnRenamed("shard", "from_shard")
    return with_shard(old, after, keys).groupBy("from_shard", F.col("shard").alias("to_shard")).agg(F.count(F.lit(1)).alias("n"))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, keys: Sequence[str] = ("doc_id",), file_rows: int = 1_000_000) -> None:
    """docs as Parquet in a folder shard=i for each shard, in files of at most file_rows rows; tasks share a large shard."""
    sharded = with_shard(docs, weights, keys).drop("grown_shard")
    spread = F.pmod(F.xxhash64(*[F.col(k) for k in sharded.columns if sharded.schema[k].dataType.typeName() != "map"]), F.lit(16))
    sharded.repartition("shard", spread).write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract, by the law `key`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes: its size is 16, its checksum that of no bytes, 0. Texts are read once and not shuffled; equal
    rows, and rows with equal or null doc_id, share a shard and have places of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("print"))
    placed = with_slot(with_shard(slim), ["doc_id", "text_crc32", "print", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: XXH64 of one 8-byte number, in steps that each read the columns of the one before; a product is taken modulo 2^64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_ALL = (1 << 64) - 1


def _times(x: str, by: int) -> str:
    return f"(({x}) * {by}::UHUGEINT % {1 << 64}::UHUGEINT)"


def _turned(x: str, bits: int) -> str:
    return f"(({x}) * {1 << bits}::UHUGEINT % {1 << 64}::UHUGEINT + ({x}) // {1 << (64 - bits)}::UHUGEINT)"


def _xor(x: str, y: str) -> str:
    return f"xor(({x})::UBIGINT, ({y})::UBIGINT)::UHUGEINT"


def hash_sql(source: str, value: str, seed: str, out: str, keep: str) -> str:
    """A subquery over `source` with `out`, the hash of a non-negative number column under a seed; `keep` columns go along."""
    q = f"SELECT {keep}, {_times(f'({value})::UHUGEINT', _P2)} AS v, (({seed}) + {_P5 + 8}::UHUGEINT) % {1 << 64}::UHUGEINT AS s FROM ({source})"
    q = f"SELECT {keep}, {_xor('s', _times(_turned('v', 31), _P1))} AS s FROM ({q})"
    q = f"SELECT {keep}, ({_times(_turned('s', 27), _P1)} + {_P4}::UHUGEINT) % {1 << 64}::UHUGEINT AS s FROM ({q})"
    for bits, by in ((33, _P2), (29, _P3), (32, 1)):
        q = f"SELECT {keep}, {_times(_xor('s', f's // {1 << bits}::UHUGEINT'), by)} AS s FROM ({q})"
    return f"SELECT {keep}, s AS {out} FROM ({q})"


#: The checksum's table by its rule, and one step for each byte of a list.
CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([i::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM range(256) t(i)))"


def crc_sql(blob: str) -> str:
    """CRC-32 of a blob; the table is at hand as the column t of a one-row relation named crc."""
    octets = f"list_transform(range(octet_length({blob})), lambda i: ('0x' || substr(hex({blob}), 2 * i::INT + 1, 2))::UBIGINT)"
    return f"xor(list_reduce([4294967295::UBIGINT] || {octets}, lambda a, x: xor(a >> 8, t[(xor(a & 255, x) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT"


def shard_sql(shards: int = SHARDS) -> str:
    first = hash_sql("SELECT r, doc_id FROM d WHERE doc_id IS NOT NULL", "doc_id", "42::UHUGEINT", "k", "r")
    first = f"SELECT r, k FROM ({first}) UNION ALL SELECT r, 42::UHUGEINT FROM d WHERE doc_id IS NULL"
    again = hash_sql(first, "k", "42::UHUGEINT", "k2", "r")
    drawn = hash_sql(f"SELECT r, k2, i FROM ({again}), range({shards + 1}) t(i)", "i", "k2", "h", "r, i")
    return f"""WITH crc AS (SELECT {CRC_TABLE} AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
drawn AS (SELECT r, i, h // {1 << 17}::UHUGEINT * {MOST_SHARDS}::UHUGEINT + {MOST_SHARDS - 1}::UHUGEINT - i::UHUGEINT AS v FROM ({drawn})),
best AS (SELECT r, arg_max(i, v) FILTER (WHERE i < {shards}) AS shard, arg_max(i, v) AS grown FROM drawn GROUP BY r),
placed AS (SELECT d.doc_id, strlen(text) + 16 AS size, {crc_sql('encode(text)')} AS text_crc32, shard, grown FROM d JOIN best USING (r), crc)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard FROM placed"""
