"""Vector codes by product quantisation, with Lloyd's rounds driven by heaps.

Vectors are cut into consecutive parts, and each part position has a codebook. A block of vectors of one partition keeps,
for each part position and entry, a heap of the parts assigned to that entry, keyed by slack: lower bound (distance to
the second nearest entry) minus upper bound (distance to the nearest), plus all drift of the entry so far. When codebooks
move, an entry's drift grows by its own move and the longest move of another entry; a part whose key is above that drift is
certainly still strictly nearest to its entry, so only keys at or below it are popped and rescanned exactly. A heap is kept
in ascending order: what is popped is its head, found by one search. Blocks with their heaps are rows of a table in the
shared folder, written once a round; sums of members are kept a block, changed by the parts that moved, and added on the
executors. Only the codebooks and their drifts, a fixed number, pass through the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.common import materialize, spread_join

PARTS, ENTRIES, SCALE, ROUNDS = 16, 64, 256, 2
#: Components of one block, about: 4,096 vectors of 64.
BLOCK_VALUES = 1 << 18


def most_component(width: int) -> int:
    """Components are held within this size, so that the error of a whole vector fits a long; 2^27 for 64 of them."""
    return math.isqrt((1 << 60) // max(1, width))


def quantised(x: np.ndarray, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of rows of components, with zeros added on the right up to `width`."""
    most = most_component(width)
    whole = np.floor(np.clip(np.asarray(x, np.float64), -1e300, 1e300) * scale)
    out = np.zeros((len(x), width), np.int64)
    out[:, : x.shape[1]] = np.clip(whole, -most, most).astype(np.int64)
    return out


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows x to the rows of book."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * int(most) ** 2 * max(1, x.shape[1]) < 1 << 52:  # every sum below is a whole number that a double holds
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - book[None, :, j]) ** 2
    return out


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower, and its slack, a little below the true one for rounding."""
    d = distances(x, book)
    at = d.argmin(axis=1)
    row = np.arange(len(x))
    upper = np.sqrt(d[row, at].astype(np.float64))
    d[row, at] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(x), np.inf)
    return at, lower - upper - 1e-9 * (upper + np.where(np.isinf(lower), 0, lower))


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(parts, entries): how far the gap between an entry and the nearest other one may have shrunk by a move of the codebooks."""
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=2))
    order = np.sort(moved, axis=1)
    others = np.repeat(order[:, -1:], moved.shape[1], axis=1)
    if moved.shape[1] > 1:
        first = moved.argmax(axis=1)
        others[np.arange(len(moved)), first] = order[:, -2]
    else:
        others[:] = 0
    return (moved + others) * (1 + 1e-9)


def _heaped(entry: np.ndarray, keys: np.ndarray, n_entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members in heap order, entry after entry, their keys, and the size of each heap; keys are rounded down to 32 bits."""
    low = keys.astype(np.float32)
    low = np.where(low > keys, np.nextafter(low, np.float32(-np.inf)), low)
    order = np.lexsort((low, entry))
    return order.astype(np.int32), low[order], np.bincount(entry, minlength=n_entries).astype(np.int32)


def _added(entry: np.ndarray, x: np.ndarray, n_entries: int) -> np.ndarray:
    """(entries, width + 1): sums of the rows of each entry, and their number."""
    out = np.zeros((n_entries, x.shape[1] + 1), np.int64)
    np.add.at(out, entry, np.column_stack([x, np.ones(len(x), np.int64)]))
    return out


def _block(ids: pa.Array, labels: pa.Array, values: bytes, heaps, sums: np.ndarray, popped: int) -> dict:
    members, keys, sizes = zip(*heaps, strict=True)
    return {"ids": ids.to_pylist(), "labels": labels.to_pylist(), "values": values, "members": b"".join(m.tobytes() for m in members), "keys": b"".join(k.tobytes() for k in keys), "sizes": b"".join(s.tobytes() for s in sizes), "sums": sums.tobytes(), "popped": popped}


def block_type(vectors: DataFrame) -> T.StructType:
    """Columns of a block: its rows, their components, the heaps, the sums and how many parts the last round rescanned."""
    array = lambda c: T.ArrayType(vectors.schema[c].dataType)
    return T.StructType([T.StructField("ids", array("vec_id")), T.StructField("labels", array("label")), *[T.StructField(c, T.BinaryType()) for c in ("values", "members", "keys", "sizes", "sums")], T.StructField("popped", T.LongType())])


def _begun(book: np.ndarray, dims: int, scale: int, kinds: pa.Schema):
    """Blocks with their heaps from a full scan against the first codebooks."""
    parts, n_entries, width = book.shape
    rows = max(64, BLOCK_VALUES // max(1, parts * width))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                flat = np.asarray(batch.column("embedding").flatten().to_numpy(zero_copy_only=False))
                x = quantised(flat.reshape(batch.num_rows, dims), parts * width, scale)
                heaps, sums = [], []
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    entry, slack = scanned(own, book[p])
                    heaps.append(_heaped(entry, slack, n_entries))
                    sums.append(_added(entry, own, n_entries))
                small = x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x
                row = _block(batch.column("vec_id"), batch.column("label"), small.tobytes(), heaps, np.stack(sums), x.shape[0] * parts)
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return run


def _opened(row: dict, parts: int, n_entries: int, width: int):
    """Components, members, keys, entries of the members and sums of a block."""
    n = len(row["ids"])
    kind = np.int16 if len(row["values"]) == 2 * n * parts * width else np.int64
    x = np.frombuffer(row["values"], kind).reshape(n, parts * width)
    members = np.frombuffer(row["members"], np.int32).reshape(parts, n)
    keys = np.frombuffer(row["keys"], np.float32).reshape(parts, n)
    sizes = np.frombuffer(row["sizes"], np.int32).reshape(parts, n_entries)
    sums = np.frombuffer(row["sums"], np.int64).reshape(parts, n_entries, width + 1).copy()
    return x, members, keys, sizes, sums


def _popped(keys: np.ndarray, sizes: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Places of the heads of all heaps of one part position that their entry's drift has reached."""
    ends = np.cumsum(sizes)
    cut = [np.arange(e - s, e - s + np.searchsorted(keys[e - s : e], m, "right")) for e, s, m in zip(ends, sizes, moved, strict=True) if s and keys[e - s] <= m]
    return np.concatenate(cut) if cut else np.zeros(0, np.int64)


def _renewed(row: dict, book: np.ndarray, moved: np.ndarray):
    """A block after the codebooks have moved: components, (entry, key) of each member in heap order, sums, parts rescanned."""
    parts, n_entries, width = book.shape
    x, members, keys, sizes, sums = _opened(row, parts, n_entries, width)
    found, n_popped = [], 0
    for p in range(parts):
        entry = np.repeat(np.arange(n_entries), sizes[p])
        key = keys[p].astype(np.float64)
        at = _popped(keys[p], sizes[p], moved[p])
        n_popped += len(at)
        if len(at):
            own = x[members[p][at], p * width : (p + 1) * width].astype(np.int64)
            new, slack = scanned(own, book[p])
            other = new != entry[at]
            if other.any():
                sums[p] += _added(new[other], own[other], n_entries) - _added(entry[at][other], own[other], n_entries)
            entry[at] = new
            key[at] = slack + moved[p][new]
        found.append((members[p], entry, key))
    return x, found, sums, n_popped


def _went_on(book: np.ndarray, moved: np.ndarray, kinds: pa.Schema):
    """Blocks after one more round."""
    n_entries = book.shape[1]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, found, sums, n_popped = _renewed(row, book, moved)
                heaps = []
                for members, entry, key in found:
                    order, low, sizes = _heaped(entry, key, n_entries)
                    heaps.append((members[order], low, sizes))
                ids, labels = (pa.array(row[c], kinds.field(c).type.value_type) for c in ("ids", "labels"))
                yield pa.RecordBatch.from_pylist([_block(ids, labels, row["values"], heaps, sums, n_popped)], schema=kinds)

    return run


def _ended(book: np.ndarray, moved: np.ndarray, kinds: pa.Schema):
    """(vec_id, label, code, error, rescanned) of each vector under the last codebooks."""
    parts, _, width = book.shape

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x, found, _, _ = _renewed(row, book, moved)
                codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p, (members, entry, _) in enumerate(found):
                    codes[members, p] = entry
                    error += ((x[:, p * width : (p + 1) * width].astype(np.int64) - book[p][codes[:, p]]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                code = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kinds.field("vec_id").type), pa.array(row["labels"], kinds.field("label").type), pa.array(code, pa.string()), pa.array(error, pa.int64())], schema=kinds)

    return run


def _totals(blocks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Sums over all blocks: one array a task, one row a cell to the driver, as many as the codebooks have."""

    def run(batches):
        total = np.zeros(math.prod(shape), np.int64)
        for batch in batches:
            for blob in batch.column("sums"):
                total += np.frombuffer(blob.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.int64())], ["cell", "value"])

    cells = blocks.select("sums").mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(math.prod(shape), np.int64)
    for r in cells.collect():
        out[r["cell"]] = r["value"]
    return out.reshape(shape)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the rows whose vector is not null, not empty, and free of null and non-finite components."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding", "label").filter((F.size("embedding") > 0) & sound)


def _first_codebooks(kept: DataFrame, parts: int, entries: int, scale: int) -> tuple[DataFrame, np.ndarray, int]:
    """The kept vectors of one length, the codebooks of the least vec_ids, and the length, that of the least vec_id."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = kept.orderBy(*order).limit(entries).collect()
    dims = len(first[0]["embedding"]) if first else 0
    same = kept.filter(F.size("embedding") == dims)
    if any(len(r["embedding"]) != dims for r in first):
        first = same.orderBy(*order).limit(entries).collect()
    width = -(-dims // parts)
    x = quantised(np.array([r["embedding"] for r in first], np.float64).reshape(len(first), dims), parts * width, scale)
    return same, x.reshape(len(first), parts, width).transpose(1, 0, 2).copy(), dims


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[DataFrame]]:
    """(vec_id, label, code, error) of every kept vector, the codebooks (part, entry, component), and the table of each round's blocks.

    Components become floor(scale * x). Rows whose vector is null, empty, or holds a null or non-finite component are
    dropped, and so are vectors of another length than that of the least vec_id; a length that `parts` does not divide is
    filled up with zeros. Components beyond most_component() in size count as that. Codebooks begin as the parts of the
    `entries` least vec_ids (nulls last, ties by components; fewer rows give fewer entries). Rows with equal vec_id, and
    repeated rows, count each. Ties go to the lower entry; entries without parts stay. Columns besides the three are ignored. An
    empty table gives an empty one.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    from pyspark.sql.pandas.types import to_arrow_schema

    kept, book, dims = _first_codebooks(kept_vectors(vectors), parts, entries, scale)
    done = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not book.shape[1]:
        return vectors.sparkSession.createDataFrame([], done), book, []
    kind = block_type(vectors)
    blocks = materialize(kept.mapInArrow(_begun(book, dims, scale, to_arrow_schema(kind)), kind), "heaps")
    tables, moved = [blocks], np.zeros(book.shape[:2])
    for k in range(rounds):
        sums = _totals(blocks, (*book.shape[:2], book.shape[2] + 1))
        count = sums[:, :, -1:]
        new = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), book)
        moved, book = moved + drift(book, new), new
        if k + 1 < rounds:
            blocks = materialize(blocks.mapInArrow(_went_on(book, moved, to_arrow_schema(kind)), kind), "heaps")
            tables.append(blocks)
    return blocks.mapInArrow(_ended(book, moved, to_arrow_schema(done)), done), book, tables


def codebooks_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def vector_codes_digest(vectors: DataFrame) -> DataFrame:
    """The columns of the contract; a sum of errors beyond a long is null."""
    codes, book, _ = compress(vectors)
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).alias("of_label")
    codes = materialize(codes.select("*", label), "codes")
    totals = materialize(codes.groupBy("of_label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "totals")
    return spread_join(codes, totals, ["of_label"]).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(book)).alias("codebooks_sha256"))


def vector_codes_sql(parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS) -> str:
    """Plain Lloyd: every part against every entry in every round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"far{k} AS (SELECT v.rid, v.part, b.entry, sum((v.x - b.x) ** 2)::BIGINT AS d FROM v JOIN book{k} b USING (part, pos) GROUP BY ALL)")
        steps.append(f"near{k} AS MATERIALIZED (SELECT rid, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM far{k} GROUP BY ALL)")
        steps.append(f"mean{k} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM near{k} JOIN v USING (rid, part) GROUP BY ALL)")
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x FROM book{k} b LEFT JOIN mean{k} USING (part, entry, pos))")
    return f"""WITH sound AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, * FROM sound WHERE len(embedding) = (SELECT len(embedding) FROM sound ORDER BY vec_id NULLS LAST, embedding LIMIT 1)),
each AS (SELECT rid, i, ceil(len(embedding) / {parts})::BIGINT AS w, floor({scale} * embedding[i + 1]::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(range(len(embedding))) AS i FROM kept)),
v AS MATERIALIZED (SELECT rid, i // w AS part, i % w AS pos, x FROM each),
book0 AS MATERIALIZED (SELECT part, rid AS entry, pos, x FROM v WHERE rid < {entries}),
{", ".join(steps[:-2])},
codes AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
(SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256 FROM kept JOIN codes USING (rid)"""
