"""AC5, Search: what satisfies the declared constraints, found first, then ranked by text and by vector within that set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import retrieval as r
from quillmesh.operators.text_index import TextIndex
from quillmesh.session import settled


def expanded(wanted: DataFrame, edges: DataFrame, along: str, depth: int) -> DataFrame:
    """wanted(q, type, dst) with of, the value asked for: dst itself and what is reached from it against `along` edges in up to `depth` steps.

    Each level keeps distinct values that were not reached before, so circles end and levels grow with the values alone.
    """
    rows = wanted.select("q", "type", "dst", F.col("dst").alias("of")).distinct()
    level = rows
    steps = edges.filter(F.col("type") == along).select(F.col("dst").alias("parent"), F.col("src").alias("child")).distinct()
    for _ in range(depth):
        level = level.join(steps, level["dst"] == steps["parent"]).select("q", "type", F.col("child").alias("dst"), "of").distinct()
        level = settled(level.join(rows, ["q", "type", "dst", "of"], "left_anti"))
        rows = rows.unionByName(level)
    return rows


def feasible(queries: DataFrame, nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q, id): the nodes(id, kind) of the kind of queries(q, kind), null for any, that meet every constraint wanted(q, type, dst, of) of the query.

    A constraint is met by an edge of its type to one of its values. Queries without constraints have no rows: all nodes of
    their kind are feasible, and no pairs are made of these.
    """
    count = wanted.groupBy("q").agg(F.count_distinct("type", "of").alias("n_wanted"))
    held = edges.select(F.col("src").alias("id"), "type", "dst").join(wanted, ["type", "dst"])
    met = held.groupBy("q", "id").agg(F.count_distinct("type", "of").alias("n_met")).join(count, "q").filter("n_met = n_wanted").select("q", "id")
    return of_kind(met, queries, nodes).select("q", "id")


def of_kind(rows: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows(q, id, ...) whose node is of the kind that the query asks for; null asks for any."""
    asked = rows.join(queries.select("q", F.col("kind").alias("__asked")), "q").join(nodes.select("id", F.col("kind").alias("__kind")), "id")
    return asked.filter("__asked is null or __asked = __kind").select(*rows.columns)


def nearest_of(queries: DataFrame, vectors: DataFrame, allowed: DataFrame, pool: int) -> DataFrame:
    """(q, id, score): the nearest of vectors(id, embedding) among allowed(q, id) to queries(q, embedding), by cosine mapped to [0, 1]; only allowed pairs are compared."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = allowed.join(vectors.select("id", F.col("embedding").alias("v")), "id").join(queries.filter("embedding is not null").select("q", F.col("embedding").alias("w")), "q")
    v, w = F.col("v"), F.col("w")
    cosine = dot(v, w) / F.greatest(F.sqrt(dot(v, v)) * F.sqrt(dot(w, w)), F.lit(1e-300))
    return r.top(pairs.select("q", "id", F.round((1 + cosine) / 2, 9).alias("score")), pool)


def nearest_free(queries: DataFrame, vectors: DataFrame, nodes: DataFrame, pool: int) -> DataFrame:
    """(q, id, score) of queries without constraints, by one pass over the vectors of each kind asked for; kinds are a fixed vocabulary."""
    asked = queries.filter("embedding is not null").select("q", "embedding", "kind")
    found = r.semantic(asked.limit(0), vectors, pool)
    for kind in [row["kind"] for row in asked.select("kind").distinct().collect()]:
        among = vectors.join((nodes if kind is None else nodes.filter(F.col("kind") == kind)).select("id"), "id", "left_semi")
        found = found.unionByName(r.semantic(asked.filter(F.col("kind").eqNullSafe(F.lit(kind))), among, pool))
    return found


def listed(queries: DataFrame, nodes: DataFrame, allowed: DataFrame, free: DataFrame, n: int) -> DataFrame:
    """(q, id, score): the first n feasible nodes by id of queries without text and vector."""
    silent = queries.filter("text is null and embedding is null").select("q", "kind")
    by_kind = nodes.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).filter(F.col("place") <= n).select("id", "kind")
    unbound = silent.join(free.select("q"), "q", "left_semi")
    some = unbound.join(by_kind, "kind").select("q", "id")
    every = unbound.filter("kind is null").select("q").crossJoin(F.broadcast(by_kind.orderBy("id").limit(n).select("id")))  # n rows
    bound = allowed.join(silent.select("q"), "q", "left_semi")
    return r.top(bound.unionByName(some).unionByName(every).withColumn("score", F.lit(0.0)), n)


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, wanted: DataFrame, index: TextIndex, vectors: DataFrame, pool: int = r.POOL, n: int = r.TOP_N, along: str = "PART_OF", depth: int = 0) -> DataFrame:
    """(q, place, id, rrf, evidence, witnesses, n_feasible, candidate_depth, truncated) for queries(q, text, embedding, kind).

    Constraints come first: channels are given the feasible set and score nothing else, so that the best `pool` of each are
    the best feasible ones. Ranks are fused, and the n best are checked against the constraints again, with the edges that
    meet them as witnesses. A query without text and vector lists its feasible set by id. n is the budget of a call: truncated
    says that more was found, and candidate_depth how deep the channels went.
    """
    wide = settled(expanded(wanted, edges, along, depth))
    allowed = settled(feasible(queries, nodes, edges, wide))
    free = queries.join(wide.select("q").distinct(), "q", "left_anti")
    texts = lambda df: df.filter("text is not null").select("q", "text")
    tied = queries.join(wide.select("q").distinct(), "q", "left_semi")
    channels = {
        "text": index.search(texts(tied), pool, allowed)[0].unionByName(index.search(texts(free), pool, keep=lambda rows: of_kind(rows, free, nodes))[0]),
        "vector": nearest_of(queries, vectors, allowed, pool).unionByName(nearest_free(free, vectors, nodes, pool)),
        "all": listed(queries, nodes, allowed, free, n + 1),
    }
    rows = None
    for name, found in channels.items():
        named = found.select("q", "id", "score", F.lit(name).alias("channel"))
        rows = named if rows is None else rows.unionByName(named)
    rows = settled(rows)
    best = settled(r.fuse(rows, n=n))
    held = edges.select(F.col("src").alias("id"), "type", "dst").join(best.select("q", "id"), "id").join(wide, ["q", "type", "dst"])
    witness = held.groupBy("q", "id").agg(F.count_distinct("type", "of").alias("n_met"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "type", "dst"))), ",").alias("witnesses"))
    asked = wide.groupBy("q").agg(F.count_distinct("type", "of").alias("n_wanted"))
    kinds = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    every = free.join(kinds.withColumnRenamed("kind", "__kind"), F.col("kind").isNull() | (F.col("kind") == F.col("__kind")), "left").groupBy("q").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_feasible"))  # a row a kind
    sizes = allowed.groupBy("q").agg(F.count(F.lit(1)).alias("n_feasible")).unionByName(every)
    depths = rows.groupBy("q", "channel").agg(F.count(F.lit(1)).alias("n")).groupBy("q").agg(F.max("n").alias("candidate_depth"))
    checked = best.join(asked, "q", "left").join(witness, ["q", "id"], "left").filter(F.coalesce("n_met", F.lit(0)) == F.coalesce("n_wanted", F.lit(0)))
    return checked.join(sizes, "q").join(depths, "q").select("q", "place", "id", "rrf", "evidence", F.coalesce("witnesses", F.lit("")).alias("witnesses"), "n_feasible", "candidate_depth", "truncated")
