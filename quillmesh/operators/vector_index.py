"""A stored vector index for RT3: coarse centroids with residual codes, probe lists, and an exact second ranking.

Centroids are fitted on a sample of at most SAMPLE vectors, a documented bound; every vector is indexed. A vector is filed
under its nearest centroid as the difference to it, in one byte a component. A search visits the `probe` cells nearest to
each query, ranks what it finds there by the codes, and ranks the best `deep` times `pool` again by the vectors themselves.
A cell is cut into chunks, so one of any size is read by many tasks; queries meet chunks, never vectors one by one, and a
task passes on the best of each query, not of each chunk. The exact path is retrieval.semantic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmesh.operators.retrieval import best_rows, kept, top, unit_rows
from quillmesh.session import settled

SAMPLE = 50_000
CHUNK = 4_096
#: Queries that are compared with a chunk at once.
TOGETHER = 256
ROUNDS = 12
#: Candidates that a task holds before it reduces them to the best of each query.
HELD = 2_000_000


def centroids(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; a cell left empty takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    book = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[i : i + 4096] @ book.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(book)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        if len(empty):
            far = np.argsort((sample * book[near]).sum(axis=1), kind="stable")[: len(empty)]
            sums[empty] = sample[far]
        book = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return book


def _filed(shared, schema: pa.Schema):
    """Chunks of coded vectors, cell by cell."""

    def run(batches):
        book, step = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column("embedding").to_pylist())
            near = (x @ book.T).argmax(axis=1)
            codes = np.clip(np.round((x - book[near]) / step), -127, 127).astype(np.int8)
            ids = batch.column("id").to_pylist()
            out = []
            for cell in np.unique(near):
                own = np.flatnonzero(near == cell)
                for at in range(0, len(own), CHUNK):
                    part = own[at : at + CHUNK]
                    out.append({"cell": int(cell), "ids": [ids[i] for i in part], "codes": codes[part].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _probes(shared, probe: int):
    def run(batches):
        book, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                sims = unit_rows(batch.column("embedding").to_pylist()) @ book.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :probe]
                q = np.repeat(np.asarray(batch.column("q").to_pylist(), np.int64), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(near.ravel().astype(np.int32))], ["q", "cell"])

    return run


def _merged(schema: pa.Schema):
    """Neighbouring chunks of one cell as chunks of up to CHUNK vectors."""

    def run(batches):
        cell, held, n = None, [], 0

        def whole():
            ids = pa.chunked_array([r[0] for r in held]).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([b"".join(r[1] for r in held)], pa.binary())], schema=schema)

        for batch in batches:
            for row in range(batch.num_rows):
                own, ids, codes = batch.column("cell")[row].as_py(), batch.column("ids")[row].values, batch.column("codes")[row].as_py()
                if held and (own != cell or n + len(ids) > CHUNK):
                    yield whole()
                    held, n = [], 0
                cell, n = own, n + len(ids)
                held.append((ids, codes))
        if held:
            yield whole()

    return run


def _ranked(shared, pool: int, schema: pa.Schema):
    """The best of each task's chunks for each of the queries that visit them, by codes; of more than HELD rows the best so far are passed on early."""

    def run(batches):
        book, step = shared.value
        held: list[tuple] = []

        def best():
            q, ids, score = held[0]
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids.tolist(), schema.field("id").type), pa.array(score, pa.float64())], schema=schema)

        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1)
                asked, ids = r.column("asked")[0].values, r.column("ids")[0].values
                q = asked.field("q").to_numpy(zero_copy_only=False)
                x = np.frombuffer(r.column("codes")[0].as_py(), np.int8).reshape(len(ids), -1) * step + book[r.column("cell")[0].as_py()]
                sims = x @ unit_rows(list(asked.field("embedding").to_numpy(zero_copy_only=False))).T
                at, col = best_rows(sims, pool)
                held.append((q[col], ids.to_numpy(zero_copy_only=False)[at], sims[at, col]))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [kept(held, pool)]
                    if len(held[0][0]) > HELD // 2:
                        yield best()
                        held = []
        if held:
            held = [kept(held, pool)]
            yield best()

    return run


class VectorIndex:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fit(self, items: DataFrame, cells: int = 0, sample: int = SAMPLE, seed: int = 7) -> None:
        """Fit the centroids on the `sample` vectors of items(id, embedding) whose ids hash least; cells is 0 for the root of twice their number."""
        drawn = items.filter("embedding is not null").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("embedding")
        x = unit_rows([r["embedding"] for r in drawn.collect()])
        book = centroids(x, cells or max(1, int((2 * len(x)) ** 0.5)), seed) if len(x) else np.zeros((0, 0))
        spread = float(np.abs(x - book[(x @ book.T).argmax(axis=1)]).max()) / 127 if len(x) else 1.0
        rows = [(i, [float(v) for v in c], max(spread, 1e-9)) for i, c in enumerate(book)]
        self.spark.createDataFrame(rows, "cell int, centroid array<double>, step double").write.mode("overwrite").parquet(f"{self.path}/centroids")

    def _model(self):
        """Centroids and the step of codes, broadcast: at most the root of twice SAMPLE rows unless `cells` says otherwise."""
        rows = sorted(self.spark.read.parquet(f"{self.path}/centroids").collect(), key=lambda r: r["cell"])
        book = np.array([r["centroid"] for r in rows]).reshape(len(rows), -1)
        return self.spark.sparkContext.broadcast((book, rows[0]["step"] if rows else 1.0))

    def add(self, items: DataFrame) -> None:
        """Append all of items(id, embedding), ids new to the index; null vectors are left out."""
        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("ids", T.ArrayType(items.schema["id"].dataType)), T.StructField("codes", T.BinaryType())])
        arrow = to_arrow_schema(schema)
        filed = items.filter("embedding is not null").select("id", "embedding").mapInArrow(_filed(self._model(), arrow), schema)
        # small chunks of a cell come together; those of a cell that fills much of a batch are spread
        near = F.when(F.size("ids") < CHUNK // 4, 0).otherwise(F.xxhash64(F.get("ids", 0)))
        filed = filed.withColumn("near", near).repartition("cell", "near").sortWithinPartitions("cell", "near").drop("near")
        filed.mapInArrow(_merged(arrow), schema).write.mode("append").parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, items: DataFrame, pool: int = 20, probe: float = 0.6, deep: int = 4) -> DataFrame:
        """(q, id, score) of the about `pool` nearest items(id, embedding) of each of queries(q, embedding), scores as in retrieval.semantic.

        probe is the share of all cells that a query visits: with all of them and a deep enough first ranking the result is
        exact; vectors with clusters need few, those without need most.
        """
        model = self._model()
        visited = max(1, round(probe * len(model.value[0])))
        asked = queries.filter("embedding is not null").select("q", "embedding")
        probes = asked.mapInArrow(_probes(model, visited), "q long, cell int").join(asked, "q")
        group = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-queries.count() // TOGETHER)))).alias("together")
        visits = probes.groupBy("cell", group).agg(F.collect_list(F.struct("q", "embedding")).alias("asked"))
        chunks = self.spark.read.parquet(f"{self.path}/cells")
        schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", items.schema["id"].dataType), T.StructField("score", T.DoubleType())])
        found = top(chunks.join(visits, "cell").select("cell", "ids", "codes", "asked").mapInArrow(_ranked(model, pool * deep, to_arrow_schema(schema)), schema), pool * deep)
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        pairs = settled(found.select("q", "id")).join(items.select("id", F.col("embedding").alias("v")), "id").join(asked.withColumnRenamed("embedding", "w"), "q")
        cosine = dot(F.col("v"), F.col("w")) / F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("w"), F.col("w"))), F.lit(1e-300))
        return top(pairs.select("q", "id", F.round((1 + cosine) / 2, 9).alias("score")), pool)
