"""Line dedup: documents that share rare lines are aligned by patience diff, and aligned common blocks leave the later one.

Lines too short to tell anything are hashed together with their neighbours: a run is as few neighbouring lines as have
`block_words` words together, counted from its first line or from its last, so a long line is a run of its own. Each line
of a document is led by the rarest shared run that it stands in, the one that fewest documents have, to the earliest
document with that run: a line has one partner, and pairs grow with the repeated lines, not with the square of a group. A pair
is aligned by the hashes of its stripped lines, rare ones first: lines unique in both, in their longest common order, then
what lies between them in the same way, and where no line is unique, by its how-manieth occurrence. Neighbouring lines
aligned with neighbouring lines are a block, and one of `block_words` words or more leaves the later document. Blocks that
stand in another order in the two documents are not aligned; with `moved` their runs are looked up as well. The earliest
document with a run is never after the one that loses it, so one copy of every line stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import SPACE, join_rows, materialize, mix64, rows_of, spread_join, wrapped

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: So many later documents are aligned with one owner in a task.
OWNER_SHARE = 2_000


def _unique(lines: list[int], lo: int, hi: int) -> dict[int, int]:
    """Lines that stand once in lines[lo:hi], with their places."""
    at: dict[int, int] = {}
    for i in range(lo, hi):
        at[lines[i]] = -1 if lines[i] in at else i
    return {x: i for x, i in at.items() if i >= 0}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs whose second members rise, by patience sorting."""
    tops: list[int] = []
    heads: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = int(np.searchsorted(tops, j)) if tops and tops[-1] >= j else len(tops)
        back[k] = heads[p - 1] if p else -1
        if p == len(tops):
            tops.append(j), heads.append(k)
        else:
            tops[p], heads[p] = j, k
    out, k = [], heads[-1] if heads else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _numbered(lines: list[int], lo: int, hi: int) -> dict[tuple[int, int], int]:
    """(line, its how-manieth occurrence in lines[lo:hi]), with its place."""
    seen: dict[int, int] = {}
    at = {}
    for i in range(lo, hi):
        seen[lines[i]] = nth = seen.get(lines[i], 0) + 1
        at[lines[i], nth] = i
    return at


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of a and b: common heads and tails, then lines unique in both, then what lies between these; lines that all repeat meet by their occurrences."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            found.append((i2, j2))
        if i == i2 or j == j2:
            continue
        ours, theirs = _unique(a, i, i2), _unique(b, j, j2)
        pairs = _rising([(p, theirs[x]) for x, p in ours.items() if x in theirs])
        if not pairs:
            ours, theirs = _numbered(a, i, i2), _numbered(b, j, j2)
            pairs = _rising([(p, theirs[x]) for x, p in ours.items() if x in theirs])
        for (p, q), (p2, q2) in zip([(i - 1, j - 1), *pairs], [*pairs, (i2, j2)], strict=True):
            if p >= i:
                found.append((p, q))
            if pairs:
                todo.append((p + 1, p2, q + 1, q2))
    return sorted(found)


def line_runs(lines, words, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, place after the last, and hash of each run: for every line the shortest that begins and that ends with it."""
    cum = np.append(0, np.cumsum(np.asarray(words, np.int64)))
    if cum[-1] < block_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(cum) - 1
    at = np.arange(n)
    end = np.searchsorted(cum, cum[:-1] + block_words, "left")
    begin = np.searchsorted(cum, cum[1:] - block_words, "right") - 1
    first = np.concatenate([at[end <= n], begin[begin >= 0]])
    last = np.concatenate([end[end <= n], at[begin >= 0] + 1])
    power, back = (np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)), dtype=np.uint64) for b in (BASE, BASE_INVERSE))
    sums = np.append(np.uint64(0), np.cumsum(mix64(np.asarray(lines, np.int64).view(np.uint64)) * power[:-1], dtype=np.uint64))
    return first, last, mix64((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def common_blocks(later: list[int], words: list[int], earlier: list[int], block_words: int, moved: bool = False) -> list[int]:
    """Places of later in aligned blocks of neighbouring lines with block_words words or more; with `moved` also in such blocks that stand anywhere else in earlier."""
    out, block = set(), []
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[k] for k, _ in block) >= block_words:
                out.update(k for k, _ in block)
            block = []
        block.append((i, j))
    if moved and len(out) < len(later):
        known = dict(zip(later, words, strict=True))  # a run with a line that later lacks is not common, whatever its words
        first, last, runs = line_runs(later, words, block_words)
        hit = np.isin(runs, line_runs(earlier, [known.get(x, 0) for x in earlier], block_words)[2])
        cover = np.zeros(len(later) + 1, np.int64)
        np.add.at(cover, first[hit], 1), np.add.at(cover, last[hit], -1)
        out.update(np.flatnonzero(np.cumsum(cover)).tolist())
    return sorted(out)


SPAN = {"run": pa.int64(), "first": pa.int32(), "last": pa.int32(), "once": pa.bool_()}


def _runs(block_words: int):
    """The runs of each document, where each of their occurrences begins and ends, and one `once` for each distinct run."""

    def run(batches):
        for batch in batches:
            parts, sizes = [], [0]
            for x, w in zip(batch.column("lines"), batch.column("words"), strict=True):
                first, last, runs = line_runs(x.values.to_numpy(), w.values.to_numpy(), block_words)
                order = np.lexsort((first, runs))
                first, last, runs = first[order], last[order], runs[order]
                new = np.ones(len(runs), bool)
                new[1:] = runs[1:] != runs[:-1]
                keep = new.copy()  # a line alone is found from both of its ends
                keep[1:] |= first[1:] != first[:-1]
                parts.append((runs[keep].view(np.int64), first[keep].astype(np.int32), last[keep].astype(np.int32), new[keep]))
                sizes.append(int(keep.sum()))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts, strict=True), SPAN.values(), strict=True)], list(SPAN)) if parts else pa.array([], pa.struct(list(SPAN.items())))
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__k"), spans], ["doc_id", "__k", "spans"])

    return run


def rarest(first: np.ndarray, last: np.ndarray, n: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which of a document's shared runs some line is led by: each line by the one that fewest documents have, ties by hash."""
    lead = np.full(int(last.max(initial=0)), -1)
    for k in np.lexsort((run, n))[::-1]:
        lead[first[k] : last[k]] = k
    return np.unique(lead[lead >= 0])


def _partners(batches):
    """The owners of the rarest runs of each document's lines, each once."""
    for batch in batches:
        ids, keys, firsts, first_keys = [], [], [], []
        for i in range(batch.num_rows):
            own = batch.column("shared")[i].values
            col = {c: own.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last", "n", "run", "owner_k")}
            lead = rarest(col["first"], col["last"], col["n"], col["run"])
            owner_id = own.field("owner_id").take(pa.array(lead)).to_pylist()
            for pair in dict.fromkeys(zip(owner_id, col["owner_k"][lead].tolist(), strict=True)):
                ids.append(batch.column("doc_id")[i].as_py()), keys.append(batch.column("__k")[i].as_py())
                firsts.append(pair[0]), first_keys.append(pair[1])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, keys, firsts, first_keys)], ["doc_id", "__k", "first_id", "first_k"])


def _aligned(block_words: int, moved: bool):
    def run(batches):
        for batch in batches:
            lines, words, earlier = (batch.column(c) for c in ("lines", "words", "earlier"))
            drop = [common_blocks(lines[i].as_py(), words[i].as_py(), earlier[i].as_py(), block_words, moved) for i in range(batch.num_rows)]  # one pair at a time in memory
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__k"), pa.array(drop, pa.list_(pa.int32()))], ["doc_id", "__k", "drop"])

    return run


def led_pairs(lined: DataFrame, block_words: int) -> DataFrame:
    """(doc_id, __k, first_id, first_k, owner): each document with the earliest documents that have the rarest runs of its lines."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__k")
    spans = lined.select("doc_id", "__k", "lines", "words").mapInArrow(_runs(block_words), "doc_id long, __k long, spans array<struct<run:long, first:int, last:int, once:boolean>>")
    each = materialize(spans.select(rank.alias("doc"), F.explode("spans").alias("at")).select("doc", "at.*"), "runs")
    again = each.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("once").cast("int")).alias("docs"), F.min("doc").alias("owner"))
    again = materialize(again.filter("docs > 1"), "again")
    found = spread_join(each, again, ["run"]).filter("doc <> owner")
    shared = found.groupBy("doc").agg(F.collect_list(F.struct("first", "last", F.col("docs").alias("n"), "run", F.col("owner.doc_id").alias("owner_id"), F.col("owner.__k").alias("owner_k"))).alias("shared"))
    pairs = shared.select("doc.doc_id", "doc.__k", "shared").mapInArrow(_partners, "doc_id long, __k long, first_id long, first_k long")
    owner = F.xxhash64(F.col("first_id").isNull(), "first_id", "first_k").alias("owner")
    return pairs.select("*", owner)


def shared_blocks(docs: DataFrame, block_words: int = 10, moved: bool = True) -> DataFrame:
    """(doc_id, __k, drop): the places of the lines that each document loses, counted from 0; documents that lose none are left out."""
    line = F.split(F.coalesce("text", F.lit("")), "\n")
    lined = rows_of(docs, "text").select(
        "doc_id",
        "__k",
        F.transform(line, lambda x: F.xxhash64(F.regexp_replace(x, rf"^{SPACE}|{SPACE}$", ""))).alias("lines"),
        F.transform(line, lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))).alias("words"),
    )
    lined = materialize(lined.dropDuplicates(["doc_id", "__k"]), "lines")
    pairs = materialize(led_pairs(lined, block_words), "pairs")
    # an owner of many later documents is sent to several tasks, each with a share of these
    owners = materialize(pairs.groupBy("owner", "first_id", "first_k").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", F.ceil(F.col("n") / OWNER_SHARE).cast("int")), "owners")
    pairs = spread_join(pairs, owners.select("owner", "n", "shares"), ["owner"]).withColumn("share", F.pmod(F.col("__k"), F.col("shares")).cast("int"))
    held = join_rows(owners.select(F.col("first_id").alias("doc_id"), F.col("first_k").alias("__k"), "owner", "shares"), lined.select("doc_id", "__k", F.col("lines").alias("earlier")), "inner")
    held = held.select("owner", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "earlier")
    both = join_rows(pairs.drop("shares", "first_id", "first_k"), lined, "inner").join(held, ["owner", "share"])
    found = both.select("doc_id", "__k", "lines", "words", "earlier").mapInArrow(_aligned(block_words, moved), "doc_id long, __k long, drop array<int>").filter("size(drop) > 0")
    return found.groupBy("doc_id", "__k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("drop")))).alias("drop"))


def _kept(text, drop):
    """The lines of text whose place is not in drop, joined again."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.when(drop.isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n"))


def dedup_lines(docs: DataFrame, **parameters) -> DataFrame:
    """docs with text freed of the blocks that an earlier document has, and n_lines and n_removed beside its own columns.

    Earlier means a smaller doc_id, null last, then the smaller text hash. Rows repeated exactly are one document and get
    the same result; null and empty texts have one empty line and lose nothing; texts of any length are aligned whole, one
    pair at a time. With `moved`, blocks that the alignment passes over because their order differs go too. All columns of docs stay, whatever their names, but those named n_lines and n_removed are replaced. An
    empty table gives an empty one.
    """
    drop = shared_blocks(docs, **parameters).withColumnRenamed("drop", "lost")
    joined = join_rows(wrapped(docs), drop, "left")
    text = F.col("row.text")
    count = F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long")
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    done = joined.select("row", _kept(text, F.col("lost")).alias("left_text"), count.alias("count"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("gone"))
    return done.select(*others, F.col("left_text").alias("text"), F.col("count").alias("n_lines"), F.col("gone").alias("n_removed"))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that is left (null for a null text), by alignment alone."""
    return dedup_lines(docs.select("doc_id", "text"), moved=False).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def drop_shared_blocks(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, n_chars counted again, with lines removed as dedup_lines does, without the documents that lost every line with a word.

    Blocks go by alignment alone. Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names are
    treated as dedup_lines does.
    """
    inner = docs.select(F.struct("*").alias("row"), "text", "doc_id")
    left = dedup_lines(inner, moved=False).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    return left.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
