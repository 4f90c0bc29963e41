"""Substring dedup: a count-min prefilter and an exact second pass over the windows it lets through.

First pass. A window of `window` words holds a shorter run of words whose hash is least in it, its anchor; equal windows
have equal anchors, at different places. Each task counts its anchors in a partition sketch (two rows of saturating
counters, sent as the cells in use), the sketches are merged cell by cell on the executors, and one bit a cell, "two or
more", is broadcast. Its size follows the corpus up to `most_bits`, a fixed bound; beyond, the sketch lets more through and
the result stays the same. An anchor's estimate is never below the count of any window that holds it.

Second pass. Windows whose anchor is estimated repeated are grouped exactly by anchor and a 64-bit hash of all their words.
Each task settles repeats among its own documents first and sends one record for each distinct window, so a passage that
stands in a third of the corpus reaches its group once a task. A passage shorter than a window, between ever different
neighbours, gives one anchor to many distinct windows; a group that is larger for it than `group_bytes` is dealt again by
the hash of the whole window, by which equal windows still meet. Positions of repeated windows go back to their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import WordHashes, chunks, materialize, mix64, rolled, rows_of, sliding, small_side, spread_left_join

SLICES = 64
ROWS = 2
MOST_BITS = 1 << 29  # of one row of the sketch: 64 MB each
#: Window hashes of one group, in bytes, beyond which the group is dealt again: two million windows.
GROUP_BYTES = 16_000_000
#: Groups to deal again, 20 bytes each, are broadcast up to so many.
BROADCAST_GROUPS = 1_000_000


def _anchors(x: np.ndarray, lens: np.ndarray, window: int):
    """Run hashes, the anchor of each window (0 where no window starts), and whether a window starts at each place."""
    inner = (window + 1) // 2
    ends = np.repeat(np.cumsum(lens), lens)
    n = max(0, len(x) - window + 1)
    starts = np.arange(n) + window <= ends[:n]
    runs = rolled(x, inner) if len(x) >= inner else np.zeros(0, np.uint64)
    least = np.maximum(sliding(runs, window - inner + 1)[:n], np.uint64(1)) if n else np.zeros(0, np.uint64)
    return np.maximum(runs, np.uint64(1)), np.where(starts, least, np.uint64(0)), starts


def _chosen(runs: np.ndarray, anchors: np.ndarray, window: int) -> np.ndarray:
    """The runs that are the anchor of some window."""
    span = window - (window + 1) // 2 + 1
    if not len(anchors):
        return np.zeros(0, np.uint64)
    pad = np.zeros(span - 1, np.uint64)
    most = sliding(np.concatenate([pad, anchors, pad]), span, np.maximum)
    return runs[: len(most)][runs[: len(most)] == most]


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix64(anchor + np.uint64(0x51ED27 * (row + 1))) & np.uint64(bits - 1)


def _sketches(window: int, bits: int):
    """Partition sketches: (slice, cells in use shifted by one, lowest bit set from two on)."""
    per = bits // SLICES

    def flush(found):
        a = np.concatenate(found)
        for row in range(ROWS):
            cell, count = np.unique(_cells(a, row, bits), return_counts=True)
            where = np.searchsorted(cell, np.arange(SLICES + 1, dtype=np.uint64) * np.uint64(per))
            code = ((cell % np.uint64(per)) << np.uint64(1) | (count > 1).astype(np.uint64)).astype("<u4")
            keep = [s for s in range(SLICES) if where[s] < where[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([row * SLICES + s for s in keep], pa.int32()), pa.array([code[where[s] : where[s + 1]].tobytes() for s in keep], pa.binary())], ["slice", "cells"])

    def run(batches):
        memo, found, n = WordHashes(), [], 0
        for part in chunks(batches, "text"):
            x, lens = memo.flat([(t or b"").split() for t in part.column("text").to_pylist()])
            runs, anchors, _ = _anchors(x, lens, window)
            found.append(_chosen(runs, anchors, window))
            n += len(found[-1])
            if n > 2_000_000:
                yield from flush(found)
                found, n = [], 0
        if n:
            yield from flush(found)

    return run


def _merge(bits: int):
    """One bit a cell, set from two on; sketches of a slice arrive one after the other."""
    per = bits // SLICES

    def run(batches):
        cells: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s not in cells and len(cells) >= 2:  # the input is sorted by slice
                    done = min(cells)
                    yield pa.RecordBatch.from_arrays([pa.array([done], pa.int32()), pa.array([np.packbits(cells.pop(done) > 1, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])
                code = np.frombuffer(blob.as_buffer(), "<u4")
                into = cells.setdefault(s, np.zeros(per, np.uint8))
                at = code >> 1
                into[at] = np.minimum(into[at] + 1 + (code & 1).astype(np.uint8), 2)
        for s, c in sorted(cells.items()):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(c > 1, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    return run


def repeated_bits(texts: DataFrame, window: int, bits: int) -> bytes:
    """The merged sketch as bits, row after row; ROWS * bits / 8 bytes at most, whatever the corpus."""
    sketches = texts.mapInArrow(_sketches(window, bits), "slice int, cells binary")
    merged = sketches.repartition(ROWS * SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_merge(bits), "slice int, bits binary")
    out = np.zeros(ROWS * bits // 8, np.uint8)
    per = bits // SLICES // 8
    for r in merged.toLocalIterator():
        out[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


MARK = pa.schema([("bucket", pa.int64()), ("ids", pa.list_(pa.int64())), ("keys", pa.binary()), ("runs", pa.binary()), ("prints", pa.binary())])
RUN = np.dtype([("anchor", "<u8"), ("doc", "<i4"), ("start", "<i4"), ("len", "<i4"), ("flag", "<i4")])


def _as_runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run; breaks says where one begins."""
    first = np.flatnonzero(breaks)
    return first, np.diff(np.append(first, len(breaks)))


def _marks(window: int, bits: int, buckets: int, sketch):
    """Candidate windows by bucket of their anchor; those that a task can settle alone go to negative buckets."""

    def known(anchor: np.ndarray, view: np.ndarray) -> np.ndarray:
        hit = anchor > 0
        for row in range(ROWS):
            cell = _cells(anchor, row, bits)
            hit &= (view[(np.uint64(row * (bits // 8)) + (cell >> np.uint64(3))).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit

    def rows(bucket_of, runs, ids, keys, prints, first):
        """One row for each bucket: its documents, its runs, and the prints of its runs."""
        order = np.argsort(bucket_of, kind="stable")
        where, size = _as_runs(np.diff(bucket_of[order], prepend=bucket_of[order][:1] - 1) != 0)
        out = {n: [] for n in MARK.names}
        for w, s in zip(where, size, strict=True):
            own = order[w : w + s]
            r = runs[own]
            docs, r["doc"] = np.unique(r["doc"], return_inverse=True)
            out["bucket"].append(int(bucket_of[own[0]]))
            out["ids"].append([ids[d] for d in docs])
            out["keys"].append(keys[docs].astype("<i8").tobytes())
            out["runs"].append(r.tobytes())
            out["prints"].append(b"" if prints is None else prints[np.repeat(first[own] - np.append(0, np.cumsum(r["len"])[:-1]), r["len"]) + np.arange(r["len"].sum())].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[n], MARK.field(n).type) for n in MARK.names], schema=MARK)

    def flush(held, ids, keys, tag):
        doc, start, anchor, prnt = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((prnt, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(prnt[order]) != 0) | (np.diff(anchor[order]) != 0)
        first, size = _as_runs(new)
        many = np.repeat(size > 1, size)
        twice, sent, flag = np.zeros(len(order), bool), np.zeros(len(order), bool), np.zeros(len(order), np.int32)
        twice[order] = many
        sent[order[first]] = True
        flag[order[first]] = size > 1
        keys = np.asarray(keys, np.int64)
        for only, local in ((twice, True), (sent, False)):
            d, s, a, p, f = doc[only], start[only], anchor[only], prnt[only], flag[only]
            if not len(d):
                continue
            brk = np.ones(len(d), bool)
            brk[1:] = (np.diff(d) != 0) | (np.diff(s) != 1)
            if not local:
                brk[1:] |= (np.diff(a) != 0) | (np.diff(f) != 0)
            at, n = _as_runs(brk)
            runs = np.empty(len(at), RUN)
            runs["anchor"], runs["doc"], runs["start"], runs["len"], runs["flag"] = 0 if local else a[at], d[at], s[at], n, f[at]
            bucket = np.full(len(at), -1 - tag, np.int64) if local else (mix64(runs["anchor"]) % np.uint64(buckets)).astype(np.int64)
            yield rows(bucket, runs, ids, keys, None if local else p, at)

    def run(batches):
        from pyspark import TaskContext

        view = np.frombuffer(sketch.value, np.uint8)
        memo, held, ids, keys, n, k = WordHashes(), [], [], [], 0, 0
        for part in chunks(batches, "text"):
            x, lens = memo.flat([(t or b"").split() for t in part.column("text").to_pylist()])
            _, anchors, _ = _anchors(x, lens, window)
            at = np.flatnonzero(known(anchors, view))
            if len(at):
                begin = np.cumsum(lens) - lens
                doc = np.searchsorted(begin, at, "right") - 1
                held.append((doc + len(ids), at - begin[doc], anchors[at], rolled(x, window, 7)[at]))
                n += len(at)
            ids += part.column("doc_id").to_pylist()
            keys += part.column("__k").to_pylist()
            if n > 1_500_000:
                yield from flush(held, ids, keys, TaskContext.get().partitionId() * 4096 + k % 4096)
                held, ids, keys, n, k = [], [], [], 0, k + 1
        if held:
            yield from flush(held, ids, keys, TaskContext.get().partitionId() * 4096 + k % 4096)

    return run


def _dealt(batches):
    """Rows of large groups cut by the hashes of their windows: equal windows get equal parts."""
    for batch in batches:
        cols = {n: batch.column(n) for n in (*MARK.names, "parts")}
        for i in range(batch.num_rows):
            ids = cols["ids"][i].as_py()
            keys, runs, prints = (np.frombuffer(cols[n][i].as_buffer(), t) for n, t in (("keys", "<i8"), ("runs", RUN), ("prints", "<u8")))
            n = runs["len"]
            each = np.repeat(runs, n)
            each["start"] += (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            each["len"] = 1
            part = (mix64(prints) % np.uint64(cols["parts"][i].as_py())).astype(np.int64)
            order = np.argsort(part, kind="stable")
            out = {n: [] for n in (*MARK.names, "part")}
            for first, size in zip(*_as_runs(np.diff(part[order], prepend=-1) != 0), strict=True):
                own = order[first : first + size]
                r = each[own]
                docs, r["doc"] = np.unique(r["doc"], return_inverse=True)
                out["bucket"].append(cols["bucket"][i].as_py())
                out["ids"].append([ids[d] for d in docs])
                out["keys"].append(keys[docs].tobytes())
                out["runs"].append(r.tobytes())
                out["prints"].append(prints[own].tobytes())
                out["part"].append(int(part[own[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if n == "part" else MARK.field(n).type) for n, v in out.items()], list(out))


def bounded_groups(marks: DataFrame, group_bytes: int) -> DataFrame:
    """marks with the column part; groups of more than group_bytes of window hashes are dealt into parts of about that many."""
    size = F.sum(F.octet_length("prints"))
    large = marks.groupBy("bucket").agg(F.ceil(size / group_bytes).cast("long").alias("parts")).filter("bucket >= 0 and parts > 1")
    large = small_side(materialize(large, "large"), BROADCAST_GROUPS)
    light = marks.join(large, "bucket", "left_anti").withColumn("part", F.lit(0).cast("long"))
    heavy = marks.join(large, "bucket").mapInArrow(_dealt, "bucket long, ids array<bigint>, keys binary, runs binary, prints binary, part long")
    return light.unionByName(heavy)


REPLY = pa.schema([("doc_id", pa.int64()), ("__k", pa.int64()), ("start", pa.int32()), ("len", pa.int32())])


def _reply(doc, start, size, ids, keys):
    return pa.table([pa.array([ids[d] for d in doc], pa.int64()), pa.array(keys[doc], pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], schema=REPLY)


def _settle(table: pa.Table) -> pa.Table:
    """Of one bucket, the runs of windows that occur twice or more."""
    ids, keys, docs, starts, anchors, flags, prints = [], [], [], [], [], [], []
    for r in table.to_batches():
        for b, i, k, run, p in zip(*(r.column(c).to_pylist() for c in MARK.names), strict=True):
            runs = np.frombuffer(run, RUN)
            doc = runs["doc"] + len(ids)
            ids += i
            keys.append(np.frombuffer(k, "<i8"))
            if b < 0:
                docs.append(doc), starts.append(runs["start"]), flags.append(runs["len"])
                continue
            n = runs["len"]
            docs.append(np.repeat(doc, n))
            starts.append(np.repeat(runs["start"] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()))
            anchors.append(np.repeat(runs["anchor"], n)), flags.append(np.repeat(runs["flag"], n))
            prints.append(np.frombuffer(p, "<u8"))
    if not docs:
        return REPLY.empty_table()
    doc, start, flag, keys = np.concatenate(docs), np.concatenate(starts), np.concatenate(flags), np.concatenate(keys)
    if not anchors:
        return _reply(doc, start, flag, ids, keys)
    anchor, prnt = np.concatenate(anchors), np.concatenate(prints)
    order = np.lexsort((prnt, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(prnt[order]) != 0) | (np.diff(anchor[order]) != 0)
    _, size = _as_runs(new)
    again = np.zeros(len(order), bool)
    again[order] = np.repeat(size > 1, size)
    only = again & (flag == 0)  # those settled by their own task have been marked by it
    doc, start = doc[only], start[only]
    if not len(doc):
        return REPLY.empty_table()
    brk = np.ones(len(doc), bool)
    brk[1:] = (np.diff(doc) != 0) | (np.diff(start) != 1)
    at, n = _as_runs(brk)
    return _reply(doc[at], start[at], n, ids, keys)


def repeated_runs(docs: DataFrame, window: int = 35, most_bits: int = MOST_BITS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, __k, start, len): at start and at the next len - 1 words of the document begin windows that occur twice or more."""
    spark = docs.sparkSession
    texts = rows_of(docs, "text").withColumn("text", F.col("text").cast("binary"))
    words = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5
    bits = 1 << 16
    while bits < min(most_bits, words * 0.6):  # anchors are a tenth of the words: a sixth of the cells in use at most
        bits *= 2
    sketch = spark.sparkContext.broadcast(repeated_bits(texts.select("text"), window, bits))
    buckets = max(16, words // 400_000)
    marks = texts.mapInArrow(_marks(window, bits, buckets, sketch), "bucket long, ids array<bigint>, keys binary, runs binary, prints binary")
    return bounded_groups(materialize(marks, "marks"), group_bytes).groupBy("bucket", "part").applyInArrow(_settle, "doc_id long, __k long, start int, len int")


def _cut(window: int):
    def run(batches):
        for part in batches:
            n_words, n_removed, kept_text = [], [], []
            for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if runs:
                    drop = np.zeros(len(words) + 1, np.int32)
                    for r in runs:
                        drop[r["start"]] += 1
                        drop[min(len(words), r["start"] + r["len"] + window - 1)] -= 1
                    keep = np.cumsum(drop[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                n_removed.append(n_words[-1] - len(words))
                kept_text.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, most_bits: int = MOST_BITS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words left joined by single spaces.

    Words are runs of other than ASCII white space. Each word covered by a window of `window` words that also starts
    anywhere else, in the same document or another, is removed; windows are judged on the input. A null or empty text has
    no words; a text shorter than the window loses none. Rows repeated exactly are occurrences like any other, so their
    windows go from each of them: their runs are gathered once, and rows repeated very often meet them in a broadcast. Rows
    with a null doc_id take part. Columns besides doc_id and text are ignored.
    """
    whole = F.coalesce("doc_id", F.lit(-1)).alias("__d")  # __k tells a null doc_id from -1
    each = repeated_runs(docs, window, most_bits, group_bytes).groupBy(whole, "__k", "start", "len").agg(F.count(F.lit(1)).alias("copies"))
    runs = materialize(each.groupBy("__d", "__k").agg(F.collect_list(F.struct("start", "len")).alias("runs"), F.max("copies").alias("n")), "runs")
    texts = rows_of(docs, "text").select("doc_id", whole, "__k", F.col("text").cast("binary").alias("text"))
    return spread_left_join(texts, runs, ["__d", "__k"]).select("doc_id", "text", "runs").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def substring_dedup_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return remove_repeats(docs, 35).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int = 35) -> list[tuple[int, int, str]]:
    """n_words, n_removed and digest of each text, from all windows at once; for tests."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        drop = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = [x for i, x in enumerate(w) if i not in drop]
        out.append((len(w), len(drop), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
