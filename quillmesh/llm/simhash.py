"""SimHash near-dedup: pigeonhole blocks, a join on blocks, and verified Hamming distances.

The 64 bits are cut into blocks; two fingerprints that differ in at most `distance` bits agree on all blocks but
`distance`, so each fingerprint is filed under every choice of that many fewer blocks and close pairs meet in one file.
Equal fingerprints are one node from the start. A file of many fingerprints is dealt into tiles of pairs of its parts; a
tile reports a spanning forest of its links, which is all that components need, so no group emits all its pairs. The
largest files are not compared in pairs at all: their fingerprints meet at the numbers half the distance from both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import LOWER_BYTES, join_rows, materialize, rows_of, spread_join, wrapped
from quillmesh.llm.components import components

SEED = 42
TILE = 1500
#: Beyond, tiles would make more rows than stars, about a thousand a fingerprint.
CROWDED = 1_000_000


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash over XXH64 (seed 42) of the space-joined word shingles, repeats included; 0 for no words."""
    words = (text or b"").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.append(0, ends[:-1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, np.uint64).astype("<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__k"), pa.array(prints, pa.int64())], ["doc_id", "__k", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, __k, fp): the fingerprint of each row's whole text as a signed 64-bit integer."""
    return rows_of(docs, "text").withColumn("text", F.col("text").cast("binary")).mapInArrow(_fingerprints(shingle), "doc_id long, __k long, fp long")


def masks(distance: int, blocks: int) -> list[int]:
    """The masks of all choices of blocks - distance blocks, as signed 64-bit integers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in (sum(c) for c in combinations(each, blocks - distance))]


def blocks_for(n: int, distance: int) -> int:
    """How many blocks keep the files of n random fingerprints small; the links found are the same for each number."""
    return distance + (2 if n < 1 << 25 else 3 if n < 1 << 30 else 4)


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints of one tile."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for at in range(0, len(front), 128):
                if not len(left):
                    break
                near = np.bitwise_count(fps[front[at : at + 128], None] ^ fps[None, left]) <= distance
                hit = near.any(axis=0)
                if hit.any():
                    parents = front[at : at + 128][near[:, hit].argmax(axis=0)]
                    edges += zip(fps[parents].view(np.int64).tolist(), fps[left[hit]].view(np.int64).tolist(), strict=True)
                    reached.append(left[hit])
                    left = left[~hit]
            front = np.concatenate(reached) if reached else front[:0]
    return edges


def _links(distance: int, small: int = 24):
    """Links inside each run of rows of one tile; rows arrive sorted by tile, and one tile is held at a time."""

    def of(fp: np.ndarray, starts: np.ndarray):
        sizes = np.diff(np.append(starts, len(fp)))
        group = np.repeat(np.arange(len(starts)), sizes)
        low = np.repeat(sizes <= small, sizes)
        a, b = [], []
        for step in range(1, int(min(small, sizes.max()))):
            hit = np.flatnonzero((group[step:] == group[:-step]) & low[step:] & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= distance))
            a.append(fp[hit].view(np.int64)), b.append(fp[hit + step].view(np.int64))
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            if e := _forest(fp[s : s + n], distance):
                x, y = zip(*e, strict=True)
                a.append(np.array(x, np.int64)), b.append(np.array(y, np.int64))
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("choice", "part", "t1", "t2", "fp")]
            held = cols if held is None else [np.concatenate(c) for c in zip(held, cols, strict=True)]
            if not len(held[0]):
                continue
            new = np.ones(len(held[0]), bool)
            new[1:] = np.any([np.diff(c) != 0 for c in held[:4]], axis=0)
            starts = np.flatnonzero(new)
            last = starts[-1]
            if last:
                yield of(held[4][:last].view(np.uint64), starts[:-1])
                held = [c[last:] for c in held]
        if held is not None and len(held[0]):
            yield of(held[4].view(np.uint64), np.zeros(1, np.int64))

    return run


def _stars(crowded: DataFrame, distance: int, chosen: list[int]) -> DataFrame:
    """(a, b): the links inside crowded(fp, choice), files of any number of fingerprints, for an even distance.

    Two fingerprints are at most `distance` bits apart if and only if some number is at most half as many bits from both,
    in bits that their file leaves free. Each is sent to all numbers so near, a fixed count; those that meet at a number,
    of which there are no more than that, are linked to the least of them.
    """
    spark = crowded.sparkSession
    free = [[b for b in range(64) if not m >> b & 1] for m in chosen]
    flips = [(i, sum(1 << b for b in c) - (1 << 64 if 63 in c else 0)) for i, bits in enumerate(free) for r in range(distance // 2 + 1) for c in combinations(bits, r)]
    flips = F.broadcast(spark.createDataFrame(flips, "choice int, flip long"))  # fixed by the number of bits and blocks
    met = crowded.join(flips, "choice").groupBy("choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    return met.filter("size(fps) > 1").select(F.explode(F.expr("slice(fps, 2, size(fps))")).alias("a"), F.col("fps")[0].alias("b")).distinct()


def close_links(distinct: DataFrame, distance: int = 4, tile: int = TILE, blocks: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links between fingerprints of distinct(fp) at most `distance` bits apart, enough to connect all that are linked.

    A file of up to `crowded` fingerprints is dealt into tiles of pairs of its parts, one of more into stars, whose rows
    grow with its size alone (an odd distance has tiles only).
    """
    blocks = blocks or blocks_for(distinct.count(), distance)
    chosen = masks(distance, blocks)
    filed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(chosen)])).alias("f")).select("fp", "f.*")
    filed = materialize(filed, "filed")
    many = materialize(filed.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("of_file", F.col("n")), "files")
    most = F.lit(crowded if distance % 2 == 0 else 1 << 62)
    shared = materialize(spread_join(filed, many, ["choice", "part"]), "shared")
    parts = F.ceil(F.col("of_file") / tile).cast("int")
    dealt = (
        shared.filter(F.col("of_file") <= most)
        .withColumn("of", F.pmod(F.xxhash64("fp"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("choice", "part", F.least("of", "other").alias("t1"), F.greatest("of", "other").alias("t2"), "fp")
    )
    tile_of = ["choice", "part", "t1", "t2"]
    links = dealt.repartition(*tile_of).sortWithinPartitions(*tile_of).mapInArrow(_links(distance), "a long, b long")
    largest = shared.filter(F.col("of_file") > most).select("fp", "choice")
    return links.union(_stars(largest, distance, chosen)) if largest.take(1) else links


def near_groups(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, __k, fp, root, which tells components apart, and component_id, the least doc_id reachable over links of at most `distance` bits.

    A null or empty text, and one of white space alone, has fingerprint 0 and is linked like any other. Texts of fewer
    words than a shingle are hashed whole, texts of any length are read whole. Equal rows share a component. Rows without
    a doc_id take part in links; the least doc_id ignores them, and is null only for a component of such rows alone. Where
    doc_ids are null or repeat, several components have one component_id. An empty table gives an empty result. Columns
    besides doc_id and text are ignored.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(close_links(distinct.select("fp"), distance))
    root = F.coalesce("root", "fp").alias("root")
    of = materialize(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", root, "least"), "roots")
    first = materialize(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "first")
    found = materialize(spread_join(of.select("fp", "root", F.col("n").alias("rows")), first, ["root"]).withColumnRenamed("rows", "n"), "found")
    return spread_join(prints, found, ["fp"]).select("doc_id", "__k", "fp", "root", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the least of their group, null last, and of rows that share it the one of least text hash.

    Of rows repeated exactly one stays. Groups without any doc_id keep the row of least text hash; null and empty texts
    are a group like any other. All columns stay, whatever their names; an empty table gives an empty one.
    """
    groups = near_groups(docs)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__k")).alias("best")).select("best.doc_id", "best.__k")
    once = wrapped(docs).dropDuplicates(["doc_id", "__k"])
    return join_rows(once, best, "left_semi").select("row.*")
