"""The write path: rules of a seed batch, the plan of what it would change, and the next state of the store.

A batch has nodes(ref, labels, name, text, direction, identifiers, aliases, own_id, plain) and rels(a, type, c); the store has
nodes(id, labels, name, text, identifiers), keys(key, raw, status, id) and edges(src, type, dst). Every step is a join or a
grouped count over whole tables, so a batch may be of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import normalize_name
from quillmesh.operators.graph import allocate

# Kinds of a seed, namespaces and whether an identifier of theirs has one holder, and ends of relationships.
SEED_KINDS = {"Entity": ("Dataset", "Model", "Benchmark"), "Concept": ("Task", "Method", "Metric")}
NAMESPACES = {"arxiv": True, "doi": True, "s2": True, "url": False}
ENDS = {"BROADER": ("Concept", "Concept", None), "OVERLAPS_WITH": ("Concept", "Concept", None), "PART_OF": ("Entity", "Entity", None), "FOR_TASK": ("Entity", "Concept", "Task")}
SYMMETRIC = ("OVERLAPS_WITH",)
_NONE = "array<string>"


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_NONE))


def _unique(identifier: Column) -> Column:
    return F.substring_index(identifier, ":", 1).isin(*[n for n, one in NAMESPACES.items() if one])


def batch_keys(nodes: DataFrame) -> DataFrame:
    """(ref, kind, raw, key) of the names and aliases of a batch; equal keys of a node count once."""
    called = nodes.select("ref", F.get("labels", 1).alias("kind"), F.explode(F.concat(F.array("name"), _list("aliases"))).alias("raw"))
    keyed = called.withColumn("key", F.concat_ws("|", normalize_name(F.col("raw")), "kind", F.lit("global")))
    return keyed.groupBy("ref", "kind", "key").agg(F.min("raw").alias("raw"))


def seed_violations(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """PF2: (ref, rule) of every broken rule of a batch: of nodes, of names and identifiers that two nodes claim, and of relationships."""
    family, kind = F.get("labels", 0), F.get("labels", 1)
    allowed = reduce(lambda w, f: w | ((family == f) & kind.isin(*SEED_KINDS[f])), SEED_KINDS, F.lit(False))
    known = lambda i: (F.instr(i, ":") > 1) & (F.substring_index(i, ":", -1) != "") & F.substring_index(i, ":", 1).isin(*NAMESPACES)
    single = {
        "two-labels": F.coalesce(F.size("labels") != 2, F.lit(True)),
        "kind-not-allowed": ~F.coalesce(allowed, F.lit(False)),
        "own-id": F.coalesce("own_id", F.lit(False)),
        "text-missing": (F.coalesce("name", F.lit("")) == "") | (F.coalesce("text", F.lit("")) == ""),
        "direction": (kind == "Metric") & ~F.coalesce(F.col("direction").isin("lower", "higher"), F.lit(False)),
        "not-plain": ~F.coalesce("plain", F.lit(True)),
        "unknown-namespace": F.exists(_list("identifiers"), lambda i: ~known(i)),
        "bar-in-name": F.exists(F.concat(F.array("name"), _list("aliases")), lambda s: F.contains(s, F.lit("|"))),
    }
    broken = lambda df, rules, ref: df.select(ref, F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))).alias("rule"))
    twice = nodes.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ref", F.lit("duplicate-ref").alias("rule"))
    claims = lambda df, by, rule: df.groupBy(by).agg(F.collect_set("ref").alias("refs")).filter(F.size("refs") > 1).select(F.explode("refs").alias("ref"), F.lit(rule).alias("rule"))
    held = nodes.select("ref", F.explode(_list("identifiers")).alias("i")).filter(_unique(F.col("i")) & known(F.col("i")))
    ends = nodes.groupBy("ref").agg(F.min("labels").alias("l")).select("ref", F.get("l", 0).alias("family"), F.get("l", 1).alias("kind"))
    a, c = (ends.select(*[F.col(x).alias(f"{side}_{x}") for x in ends.columns]) for side in "ac")
    met = rels.join(a, F.col("a") == F.col("a_ref"), "left").join(c, F.col("c") == F.col("c_ref"), "left")
    fits = reduce(lambda w, t: w | ((F.col("type") == t) & (F.col("a_family") == ENDS[t][0]) & (F.col("c_family") == ENDS[t][1]) & (F.lit(True) if ENDS[t][2] is None else F.col("c_kind") == ENDS[t][2])), ENDS, F.lit(False))
    fits &= (F.col("type") != "BROADER") | (F.col("a_kind") == F.col("c_kind"))
    inside = F.col("a_ref").isNotNull() & F.col("c_ref").isNotNull()
    of_rels = {"end-missing": ~inside, "unknown-type": ~F.col("type").isin(*ENDS), "ends-not-allowed": inside & F.col("type").isin(*ENDS) & ~F.coalesce(fits, F.lit(False))}
    same = F.when(F.col("type").isin(*SYMMETRIC), F.struct(F.least("a", "c").alias("x"), "type", F.greatest("a", "c").alias("y"))).otherwise(F.struct(F.col("a").alias("x"), "type", F.col("c").alias("y")))
    again = rels.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("ref")).filter("n > 1").select("ref", F.lit("duplicate-relation").alias("rule"))
    parts = [broken(nodes, single, "ref"), twice, claims(held, "i", "shared-identifier"), claims(batch_keys(nodes), "key", "shared-key"), broken(met, of_rels, F.col("a").alias("ref")), again]
    return reduce(DataFrame.unionByName, parts).distinct()


def targets(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(ref, target): the one object that the key of a node's name already leads to; nodes without such an object are left out."""
    named = nodes.select("ref", F.concat_ws("|", normalize_name(F.col("name")), F.get("labels", 1), F.lit("global")).alias("key"))
    return named.join(keys.filter("id is not null").select("key", "id"), "key").groupBy("ref").agg(F.min("id").alias("target"), F.countDistinct("id").alias("n")).filter("n = 1").drop("n")


def key_actions(nodes: DataFrame, keys: DataFrame, of: DataFrame) -> DataFrame:
    """AC16: (ref, action, what) for every key of a batch: new, same, or a conflict; registering a key of the same object again changes nothing."""
    held = keys.groupBy("key").agg(F.count_if(F.col("status") != "active").alias("unclear"), F.array_sort(F.collect_set("id")).alias("ids"))
    met = batch_keys(nodes).join(of, "ref", "left").join(held, "key", "left")
    own = F.coalesce(F.col("ids") == F.array("target"), F.lit(False))
    action = F.when(F.col("unclear") > 0, "conflict:key-ambiguous").when(F.coalesce(F.size("ids"), F.lit(0)) <= 0, "key:new").when(own, "key:same").otherwise("conflict:key-taken")
    return met.select("ref", action.alias("action"), F.col("key").alias("what"))


def commit_plan(nodes: DataFrame, rels: DataFrame, store: DataFrame, keys: DataFrame, edges: DataFrame) -> DataFrame:
    """AC3: (ref, action, what) of all that a batch would change, leave, or clash with; candidates are shared identifiers of namespaces with several holders."""
    of = targets(nodes, keys)
    old = store.select(F.col("id").alias("target"), F.array_sort("labels").alias("o_labels"), F.col("text").alias("o_text"), F.col("identifiers").alias("o_ids"))
    met = nodes.join(of, "ref", "left").join(old, "target", "left")
    same = F.col("o_text").eqNullSafe(F.col("text")) & (F.size(F.array_except(_list("identifiers"), _list("o_ids"))) == 0)
    action = F.when(F.col("target").isNull(), "node:new").when(F.col("o_labels") != F.array_sort("labels"), "conflict:label-mismatch").when(same, "node:same").otherwise("node:update")
    of_nodes = met.select("ref", action.alias("action"), F.coalesce("target", "name").alias("what"))
    claimed = nodes.select("ref", F.explode(_list("identifiers")).alias("what")).join(of, "ref", "left")
    holders = store.select(F.col("id").alias("holder"), F.explode(_list("identifiers")).alias("what"))
    others = claimed.join(holders, "what", "left").groupBy("ref", "what", "target").agg(F.count_if(F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("target"))).alias("in_graph"))
    fresh = claimed.filter("target is null").groupBy("what").agg(F.countDistinct("ref").alias("in_batch"))
    taken = F.when(_unique(F.col("what")) & (F.col("in_graph") > 0), "conflict:identifier-taken").when(~_unique(F.col("what")) & F.col("target").isNull() & ((F.col("in_graph") > 0) | (F.col("in_batch") > 1)), "candidate")
    of_ids = others.join(fresh, "what", "left").select("ref", taken.alias("action"), "what").filter("action is not null")
    a, c = of.select(F.col("ref").alias("a"), F.col("target").alias("a_id")), of.select(F.col("ref").alias("c"), F.col("target").alias("c_id"))
    ends = rels.join(a, "a", "left").join(c, "c", "left")
    there = edges.select(F.col("src").alias("a_id"), "type", F.col("dst").alias("c_id"))
    there = there.union(there.filter(F.col("type").isin(*SYMMETRIC)).select("c_id", "type", "a_id")).distinct().withColumn("there", F.lit(True))
    of_rels = ends.join(there, ["a_id", "type", "c_id"], "left").select(F.col("a").alias("ref"), F.when(F.col("there"), "rel:same").otherwise("rel:new").alias("action"), F.concat_ws(" ", "type", "c").alias("what"))
    return reduce(DataFrame.unionByName, [of_nodes, key_actions(nodes, keys, of), of_ids, of_rels])


def applied(nodes: DataFrame, rels: DataFrame, store: DataFrame, keys: DataFrame, edges: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SK1: the store's next nodes, keys and edges; all of a batch or, if anything clashes, an error and nothing.

    New objects are numbered on from last(kind, last_number) in the order of their refs.
    """
    plan = commit_plan(nodes, rels, store, keys, edges)
    clash = plan.filter(F.col("action").startswith("conflict")).take(1)
    if clash:
        raise ValueError(f"batch rejected: {clash[0].ref} {clash[0].action} {clash[0].what}")
    of = targets(nodes, keys)
    fresh = nodes.join(of, "ref", "left_anti")
    new = allocate(fresh.select(F.get("labels", 1).alias("kind"), F.col("ref").alias("pos")), last, F.lower("kind")).select(F.col("pos").alias("ref"), F.col("new_id").alias("id"))
    ids = of.select("ref", F.col("target").alias("id")).unionByName(new)
    whole = nodes.join(ids, "ref").select("id", "labels", "name", "text", "identifiers")
    updates = whole.select("id", F.col("text").alias("n_text"), F.col("identifiers").alias("n_ids"))
    kept = store.join(updates, "id", "left").select("id", "labels", "name", F.coalesce("n_text", "text").alias("text"), F.array_union(_list("identifiers"), _list("n_ids")).alias("identifiers"))
    next_nodes = kept.unionByName(whole.join(store.select("id"), "id", "left_anti"))
    added = batch_keys(nodes).join(keys.select("key"), "key", "left_anti").join(ids, "ref").select("key", "raw", F.lit("active").alias("status"), "id")
    ends = rels.join(ids.select(F.col("ref").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("ref").alias("c"), F.col("id").alias("dst")), "c").select("src", "type", "dst")
    return next_nodes, keys.unionByName(added), edges.unionByName(ends.exceptAll(ends.intersect(edges))).distinct()
