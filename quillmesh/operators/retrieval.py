"""Hybrid search: name and text scores, vectors, reciprocal rank fusion and three-stage resolution, for many queries at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmesh.functions.text import tokens
from quillmesh.session import settled

POOL = 20
RRF_K = 10
TOP_N = 5
MOST_QUERIES = 10_000
#: Similarities held at once.
CELLS = 4_000_000
#: Wanted terms that are sent to a vocabulary, with their shortened forms.
FEW_TERMS = 2_000
#: Namespaces in which an identifier belongs to one object only.
UNIQUE_NAMESPACES = ("arxiv", "doi", "s2")


def _less_one(term: Column) -> Column:
    """All strings that lack one character of term."""
    n = F.char_length(term)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, n)))
    return F.when(n > 0, cut).otherwise(F.array(term))


def near_forms(term: Column) -> Column:
    """The term and what is left of it without one or two characters: terms within two edits share a form."""
    one = _less_one(term)
    return F.array_distinct(F.concat(F.array(term), one, F.flatten(F.transform(one, _less_one))))


def matching_terms(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(term, match, weight) for wanted(term) against known(match): 4 if equal, 2 if it begins the match, 1 within two edits.

    Prefixes and shortened forms turn both comparisons into equi-joins on the vocabularies; the largest weight counts. Few
    wanted terms are sent to the known ones, whose many forms then stay where they are; more meet them in a shuffle.
    """
    wanted = settled(wanted)
    near_by = F.broadcast if wanted.limit(FEW_TERMS + 1).count() <= FEW_TERMS else lambda df: df
    # by a number of parts of its own: the vocabulary is small and its forms are many, so the work would come together in one task
    known = known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), "match")
    starts = known.select("match", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("match")), lambda i: F.substring("match", F.lit(1), i))).alias("term"))
    prefix = starts.join(near_by(wanted), "term").select("term", "match", F.when(F.col("term") == F.col("match"), 4).otherwise(2).alias("weight"))
    forms = known.select("match", F.explode(near_forms(F.col("match"))).alias("form"))
    near = forms.join(near_by(wanted.select("term", F.explode(near_forms(F.col("term"))).alias("form"))), "form").select("term", "match").distinct()
    fuzzy = near.filter(F.levenshtein("term", "match") <= 2).withColumn("weight", F.lit(1))
    return prefix.unionByName(fuzzy).groupBy("term", "match").agg(F.max("weight").alias("weight"))


def lexical_name(queries: DataFrame, names: DataFrame) -> DataFrame:
    """RT1: (q, id, score) of queries(q, text) over names(id, raw); the best name of each object counts.

    A name scores, over the query's terms, the largest weight among its own terms, over the root of its number of terms.
    """
    asked = queries.select("q", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    raws = names.select("raw").distinct().select("raw", F.array_distinct(tokens(F.col("raw"))).alias("terms"))
    words = raws.select("raw", F.size("terms").alias("n"), "terms").select("raw", "n", F.explode("terms").alias("match"))
    pairs = matching_terms(asked.select("term").distinct(), words.select("match").distinct())
    best = asked.join(pairs, "term").join(words, "match").groupBy("q", "raw", "n", "term").agg(F.max("weight").alias("w"))
    scored = best.groupBy("q", "raw", "n").agg(F.sum("w").alias("w")).select("q", "raw", (F.col("w") / F.sqrt("n")).alias("score"))
    return scored.join(names.select("id", "raw").distinct(), "raw").groupBy("q", "id").agg(F.max("score").alias("score"))


def bm25(queries: DataFrame, texts: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """RT2: (q, id, score), rounded to six places, of queries(q, text) over texts(id, text).

    Only terms that a query has are counted by document; document lengths come from the same pass.
    """
    asked = queries.select("q", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    split = texts.select("id", tokens(F.col("text")).alias("ts")).filter(F.size("ts") > 0)
    stats = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("mean"))
    counted = split.select("id", F.size("ts").alias("len"), "ts")  # before the explode: else each term carries them all
    hits = counted.select("id", "len", F.explode("ts").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = hits.groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = tf.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    return scored.groupBy("q", "id").agg(F.round(F.sum(part), 6).alias("score"))


def _term_key(text: Column) -> Column:
    """The distinct tokens of a text in order; texts that share it score alike as queries, and as names."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(text))), " ")


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries(q, text, wanted) as (q, wanted, key), the distinct (key, wanted), and (key, term)."""
    rows = queries.select("q", "wanted", _term_key(F.col("text")).alias("key")).filter("key <> ''")
    return rows, rows.select("key", "wanted").distinct(), rows.select("key").distinct().select("key", F.explode(F.split("key", " ")).alias("term"))


def best_of(scored: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """(key, wanted, id, score): the n best of scored(key, id, kind, score) for each of keys(key, wanted); a null `wanted` admits every kind."""
    met = scored.join(keys, "key").filter("wanted is null or wanted = kind")
    place = F.row_number().over(Window.partitionBy("key", "wanted").orderBy(F.desc("score"), "id"))
    return met.withColumn("place", place).filter(F.col("place") <= n).select("key", "wanted", "id", "score")


def dealt(rows: DataFrame, best: DataFrame) -> DataFrame:
    """(q, id, score): what was found for the key of each query."""
    b = best.withColumnsRenamed({"key": "__key", "wanted": "__wanted"})
    return rows.join(b, (F.col("key") == F.col("__key")) & F.col("wanted").eqNullSafe(F.col("__wanted"))).select("q", "id", "score")


def first_ids(rows: DataFrame, by: list[str], n: int, *better: Column) -> DataFrame:
    """The n first of each group: of ids that score alike, no later one can be among a query's n best."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*better, "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def lexical_top(queries: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """RT1: (q, id, score), the n best by lexical_name of queries(q, text, wanted) over names(id, raw, kind) of the kind wanted, null for any.

    Names of as many terms that meet the same asked terms with the same weights score alike for every query, as numbers do that
    begin alike: scores are worked out for these classes of names, the n first ids of a class and kind stand for the rest, and each
    query is given what its terms found. Rows grow with the names and with the pairs of terms, not with queries by names.
    """
    rows, keys, asked = _asked(queries)
    formed = names.select("id", "kind", _term_key(F.col("raw")).alias("form")).filter("form <> ''")
    words = formed.select("form").distinct().select("form", F.explode(F.split("form", " ")).alias("match"))
    pairs = matching_terms(asked.select("term").distinct(), words.select("match").distinct())
    hits = pairs.groupBy("match").agg(F.collect_list(F.concat_ws(":", "weight", "term")).alias("hits"))
    met = words.join(hits, "match").groupBy("form").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), " ").alias("like"))
    met = met.select("form", F.size(F.split("form", " ")).alias("n"), "like")
    hit = F.split("hit", ":")
    classes = met.select("n", "like").distinct().select("n", "like", F.explode(F.split("like", " ")).alias("hit")).select("n", "like", hit[1].alias("term"), hit[0].cast("int").alias("weight"))
    best = asked.join(classes, "term").groupBy("key", "n", "like", "term").agg(F.max("weight").alias("w"))
    scored = best.groupBy("key", "n", "like").agg(F.sum("w").alias("w")).select("key", "n", "like", (F.col("w") / F.sqrt("n")).alias("score"))
    place = F.dense_rank().over(Window.partitionBy("n", "like", "kind").orderBy("id"))  # an id may have several names of a class
    first = formed.join(met, "form").select("n", "like", "kind", "id", place.alias("place")).filter(F.col("place") <= n).drop("place")
    found = scored.join(first, ["n", "like"]).groupBy("key", "id", "kind").agg(F.max("score").alias("score"))
    return dealt(rows, best_of(found, keys, n))


def bm25_top(queries: DataFrame, texts: DataFrame, n: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """RT2: (q, id, score), the n best by bm25 of queries(q, text, wanted) over texts(id, text, kind) of the kind wanted, null for any.

    Texts of one length with the same asked terms, repeats included, score alike: they are scored as one, and the n first ids of
    each kind stand for the rest.
    """
    rows, keys, asked = _asked(queries)
    split = texts.select("id", "kind", tokens(F.col("text")).alias("ts")).filter(F.size("ts") > 0)
    stats = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("mean"))
    hits = split.select("id", "kind", F.size("ts").alias("len"), "ts").select("id", "kind", "len", F.explode("ts").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    like = hits.groupBy("id", "kind", "len").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("like"))
    classes = like.groupBy("len", "like").agg(F.count(F.lit(1)).alias("n_ids"))
    tf = classes.select("len", "like", "n_ids", F.explode(F.split("like", " ")).alias("term")).groupBy("len", "like", "n_ids", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.sum("n_ids").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = tf.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    scored = scored.groupBy("key", "len", "like").agg(F.round(F.sum(part), 6).alias("score"))
    found = scored.join(first_ids(like, ["len", "like", "kind"], n), ["len", "like"]).select("key", "id", "kind", "score")
    return dealt(rows, best_of(found, keys, n))


def unit_rows(vectors, dims: int = 0) -> np.ndarray:
    """Rows of doubles of length one; null rows become zeros, `dims` of them where no row tells how many."""
    dims = max((len(v) for v in vectors if v is not None), default=dims)
    x = np.array([v if v is not None else [0.0] * dims for v in vectors], float).reshape(len(vectors), dims)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def best_rows(sims: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `pool` largest of each column; of equal ones the upper rows."""
    if len(sims) <= pool:
        return tuple(x.ravel() for x in np.indices(sims.shape))
    kth = np.partition(sims, len(sims) - pool, axis=0)[len(sims) - pool]
    above, equal = sims > kth, sims == kth
    return np.nonzero(above | (equal & (equal.cumsum(axis=0) <= pool - above.sum(axis=0))))


def _nearest(asked, pool: int, kind: pa.DataType):
    """Each task's `pool` nearest items of every query; similarities are worked out for CELLS of them at a time."""

    def run(batches):
        ids, matrix = asked.value
        held: list[tuple] = []
        for batch in batches:
            own = np.array(batch.column("id").to_pylist(), dtype=object)
            order = np.argsort(own, kind="stable") if len(own) else []
            x, own = unit_rows(batch.column("embedding").to_pylist(), matrix.shape[1])[order], own[order]
            if not matrix.shape[1]:  # all queries of the block are null: each is a row of zeros
                matrix = np.zeros((len(ids), x.shape[1]))
            step = max(1, CELLS // max(1, len(x)))
            for at in range(0, len(ids) if len(x) else 0, step):
                sims = np.round((1 + x @ matrix[at : at + step].T) / 2, 9)
                row, col = best_rows(sims, pool)
                held.append((col + at, own[row], sims[row, col]))
            if sum(len(h[0]) for h in held) > 4 * pool * len(ids) + 100_000:
                held = [kept(held, pool)]
        if held:
            q, found, score = kept(held, pool)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in q], pa.int64()), pa.array(found.tolist(), kind), pa.array(score, pa.float64())], ["q", "id", "score"])

    return run


def kept(held: list[tuple], pool: int) -> tuple:
    """The `pool` best of each query, ties by id."""
    q, ids, score = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(ids, kind="stable")
    order = order[np.lexsort((-score[order], q[order]))]
    q, ids, score = q[order], ids[order], score[order]
    first = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - first < pool
    return q[keep], ids[keep], score[keep]


def semantic(queries: DataFrame, items: DataFrame, pool: int = POOL) -> DataFrame:
    """RT3: (q, id, score) of the `pool` nearest items(id, embedding) of each of queries(q, embedding), by cosine mapped to [0, 1].

    Exact: every task compares its items with the queries and passes on its own best `pool` of each. Queries are broadcast
    in blocks of up to about MOST_QUERIES, a fixed size; a second block and further ones each pass over the items, are
    written, and then leave the executors.
    """
    spark, n = items.sparkSession, queries.count()
    schema = f"q long, id {items.schema['id'].dataType.simpleString()}, score double"
    kind = to_arrow_type(items.schema["id"].dataType)
    blocks = -(-n // MOST_QUERIES)
    blocks = blocks if blocks < 2 else 2 * blocks
    parts = []
    for i in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()
        asked = spark.sparkContext.broadcast(([r["q"] for r in rows], unit_rows([r["embedding"] for r in rows])))
        local = top(items.select("id", "embedding").mapInArrow(_nearest(asked, pool, kind), schema), pool)
        parts.append(local if blocks == 1 else settled(local))
        if blocks > 1:
            asked.unpersist()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def top(scored: DataFrame, n: int) -> DataFrame:
    """TK1: the n best of each query by score, then by id."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def fuse(channels: DataFrame, k: int = RRF_K, n: int = TOP_N) -> DataFrame:
    """WN1, TK2: (q, id, place, rrf, evidence, truncated) of channels(q, channel, id, score) by reciprocal ranks, ties by id."""
    ranked = channels.withColumn("rank", F.row_number().over(Window.partitionBy("q", "channel").orderBy(F.desc("score"), "id")))
    fused = ranked.groupBy("q", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "channel", "rank"))), ",").alias("evidence"))
    every = Window.partitionBy("q")
    placed = fused.withColumn("place", F.row_number().over(every.orderBy(F.desc("rrf"), "id"))).withColumn("truncated", F.count(F.lit(1)).over(every) > n)
    return placed.filter(F.col("place") <= n).select("q", "id", "place", "rrf", "evidence", "truncated")


def fuse_pinned(pinned: DataFrame, channels: DataFrame, k: int = RRF_K, n: int = TOP_N) -> DataFrame:
    """WN2: like fuse, but what pinned(q, id, at) names comes first, in its order."""
    ranked = channels.withColumn("rank", F.row_number().over(Window.partitionBy("q", "channel").orderBy(F.desc("score"), "id")))
    fused = ranked.groupBy("q", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"))
    both = fused.join(pinned, ["q", "id"], "full")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("at").asc_nulls_last(), F.col("rrf").desc_nulls_last(), "id"))
    return both.withColumn("place", place).filter(F.col("place") <= n).select("q", "id", "place", "rrf", F.col("at").isNotNull().alias("pinned"))


def _held(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(identifier, kind, id) of the nodes that hold an identifier that queries of their kind ask for, each once."""
    held = nodes.select("kind", "id", F.explode("identifiers").alias("identifier"))
    return held.join(queries.select("identifier", "kind").distinct(), ["identifier", "kind"], "left_semi").select("identifier", "kind", "id").distinct()


def _owned(keyed: DataFrame, name_keys: DataFrame) -> DataFrame:
    """(__key, id, key_status) of the owners of the exact keys of keyed(__key), each once."""
    owned = name_keys.withColumnRenamed("key", "__key").join(keyed.select("__key").distinct(), "__key", "left_semi")
    return owned.groupBy("__key", F.col("object_id").alias("id")).agg(F.max("status").alias("key_status"))


def _keyed(queries: DataFrame, scope: str) -> DataFrame:
    return queries.withColumn("__key", F.concat_ws("|", "mention", "kind", F.lit(scope)))


def _hits(queries: DataFrame, nodes: DataFrame, name_keys: DataFrame, scope: str) -> DataFrame:
    """queries with h, the holders of the identifier, a, the owners of the exact key, and the key's status; lists are gathered once for each identifier and key."""
    keyed = _keyed(queries, scope)
    h = _held(queries, nodes).groupBy("identifier", "kind").agg(F.array_sort(F.collect_list("id")).alias("h"))
    a = _owned(keyed, name_keys).groupBy("__key").agg(F.array_sort(F.collect_list("id")).alias("a"), F.max("key_status").alias("key_status"))
    none = F.array().cast("array<string>")
    return keyed.join(h, ["identifier", "kind"], "left").join(a, "__key", "left").drop("__key").withColumns({"h": F.coalesce("h", none), "a": F.coalesce("a", none), "key_status": F.coalesce("key_status", F.lit("none"))})


def _counts(queries: DataFrame, nodes: DataFrame, name_keys: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """queries with __key, n_h, n_a and n_both, how many hold the identifier, own the key and do both, the first that does both, and the key's status; and the lists (gid, refs) themselves.

    An identifier or key of many nodes is asked for by many queries: lists beside each query would be their product. They are
    written once and keep to themselves; a node that both holds and owns is found by its id, without comparing lists.
    """
    keyed = _keyed(queries, scope)
    held, owned = _held(queries, nodes), _owned(keyed, name_keys)
    gid = lambda what, *by: F.concat_ws("\n", F.lit(what), *by)
    refs = F.array_sort(F.collect_list("id")).alias("refs")
    lists = held.groupBy("identifier", "kind").agg(refs).select(gid("h", "kind", "identifier").alias("gid"), "refs", F.lit(None).cast("string").alias("key_status"))
    lists = settled(lists.unionByName(owned.groupBy("__key").agg(refs, F.max("key_status").alias("key_status")).select(gid("a", "__key").alias("gid"), "refs", "key_status")))
    asked = keyed.select("identifier", "kind", "__key").distinct()
    both = held.join(owned.drop("key_status"), "id").groupBy("identifier", "kind", "__key").agg(F.count(F.lit(1)).alias("n_both"), F.min("id").alias("first_both")).join(asked, ["identifier", "kind", "__key"], "left_semi")
    size = F.size("refs")
    rows = keyed.withColumns({"h_gid": gid("h", "kind", "identifier"), "a_gid": gid("a", "__key")})
    rows = rows.join(lists.select(F.col("gid").alias("h_gid"), size.alias("n_h")), "h_gid", "left").join(lists.select(F.col("gid").alias("a_gid"), size.alias("n_a"), "key_status"), "a_gid", "left")
    rows = rows.join(both, ["identifier", "kind", "__key"], "left").drop("__key")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.withColumns({"n_h": F.when(F.col("identifier").isNotNull() & F.col("kind").isNotNull(), zero("n_h")).otherwise(0), "n_a": zero("n_a"), "n_both": zero("n_both"), "key_status": F.coalesce("key_status", F.lit("none"))}), lists


def resolve(queries: DataFrame, nodes: DataFrame, name_keys: DataFrame, scope: str = "global", n: int = TOP_N) -> DataFrame:
    """AC1: (q, stage, status, refs, resolution, issue, value) for queries(q, identifier, mention, kind, mode).

    First the holders of the identifier, then the owners of the exact key decide; queries that neither settles are searched
    by name and description, fused by rank, and get up to n candidates. value is true if resolved, else null (unknown). All is
    decided by counts; refs, which may be long lists that many queries share, are put in last and are not shuffled with the queries.
    """
    seen, lists = _counts(queries, nodes, name_keys, scope)
    unique = F.coalesce(F.substring_index("identifier", ":", 1).isin(*UNIQUE_NAMESPACES), F.lit(False))
    named = (F.col("key_status") == "active") & (F.col("n_a") == 1)
    unclear = F.col("key_status") == "ambiguous"
    has_h, has_a = F.col("n_h") > 0, F.col("n_a") > 0
    agreed = (F.col("n_both") == 1) & (named | unclear | unique)
    h, a = (F.struct(F.col(f"{c}_gid").alias("gid"), F.lit(None).cast("string").alias("one")) for c in "ha")
    both = F.struct(F.lit(None).cast("string").alias("gid"), F.col("first_both").alias("one"))
    out = lambda stage, status, refs: F.struct((F.lit(stage) if isinstance(stage, str) else stage).alias("stage"), F.lit(status).alias("status"), refs.alias("refs"))
    decided = (
        F.when(has_h & (F.col("mode") == "write") & ~unique, F.when(named, out("alias", "resolved", a)).otherwise(out("id", "candidates", h)))
        .when(has_h & has_a, F.when(agreed, out(F.when(unique, "id").otherwise("alias"), "resolved", both)).otherwise(out("id", "ambiguous", h)))
        .when(has_h, F.when(unique & (F.col("n_h") == 1), out("id", "resolved", h)).when(F.col("n_h") > 1, out("id", "ambiguous", h)).otherwise(out("id", "candidates", h)))
        .when(unclear, out("alias", "ambiguous", a))
        .when(named, out("alias", "resolved", a))
        .when(F.col("n_a") > 1, out("alias", "ambiguous", a))
    )
    disjoint = has_h & has_a & ~((F.col("mode") == "write") & ~unique) & ~agreed & (F.col("n_both") == 0)
    seen = settled(seen.select("q", "kind", "mention", decided.alias("d"), F.when(disjoint, "id-name-disjoint").alias("issue")))
    open_ = seen.filter("d is null").select("q", "kind", F.col("mention").alias("text"))
    wanted = open_.filter("kind is not null").select("q", "text", F.col("kind").alias("wanted"))
    kinds = nodes.select("id", "kind")
    names = name_keys.select(F.col("object_id").alias("id"), "raw").join(kinds, "id")
    texts = nodes.select("id", F.col("description").alias("text"), "kind")
    channels = lexical_top(wanted, names, POOL).withColumn("channel", F.lit("name")).unionByName(bm25_top(wanted, texts, POOL).withColumn("channel", F.lit("text")))
    near = fuse(channels, n=n).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("near"))
    joined = seen.join(near, "q", "left").withColumn("gid", F.col("d.refs.gid")).join(lists.select("gid", "refs"), "gid", "left")
    found = F.col("near").isNotNull()
    stage = F.coalesce("d.stage", F.lit("semantic"))
    status = F.coalesce("d.status", F.when(found, "candidates").otherwise("none"))
    refs = F.coalesce("refs", F.when(F.col("d.refs.one").isNotNull(), F.array("d.refs.one")), F.transform("near", lambda x: x["id"]), F.array().cast("array<string>"))
    resolution = F.when(status == "resolved", "resolved").when(F.col("issue").isNotNull(), "conflicting").when(status == "ambiguous", "ambiguous").when(status == "candidates", "unresolved").otherwise("missing")
    return joined.select("q", stage.alias("stage"), status.alias("status"), refs.alias("refs"), resolution.alias("resolution"), "issue", F.when(status == "resolved", True).alias("value"))
