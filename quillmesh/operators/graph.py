"""Graph access: lookups, neighbours, expansion, experiments, evidence and integrity reports over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import settled

SYMMETRIC = ("OVERLAPS_WITH", "DIFFERS_FROM", "CONTRADICTS")

#: Rows numbered in one task.
RANGE_ROWS = 20_000
#: Targets that meet all baselines of a version in one task.
BLOCK_PAPERS = 500


def exact_owners(mentions: DataFrame, name_keys: DataFrame, kind: str, scope: str = "global") -> DataFrame:
    """JN1: the owners of each mention's exact key; mentions without an owner stay with an empty list."""
    keyed = mentions.withColumn("key", F.concat_ws("|", "mention", F.lit(kind), F.lit(scope)))
    owners = name_keys.groupBy("key").agg(F.array_sort(F.collect_set("object_id")).alias("owners"), F.max("status").alias("status"))
    return keyed.join(owners, "key", "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))


def holders(identifiers: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN2: (identifier, id) of every node that has one of the identifiers, over an inverted list."""
    return identifiers.join(nodes.select("id", F.explode("identifiers").alias("identifier")), "identifier").select("identifier", "id").distinct()


def label_mismatches(batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN3: rows of batch(id, family, kind) whose stored labels differ."""
    stored = nodes.select("id", F.col("family").alias("stored_family"), F.col("kind").alias("stored_kind"))
    return batch.join(stored, "id").filter((F.col("family") != F.col("stored_family")) | (F.col("kind") != F.col("stored_kind")))


def _canonical(edges: DataFrame) -> DataFrame:
    sym = F.col("type").isin(*SYMMETRIC)
    return edges.select(F.when(sym, F.least("src", "dst")).otherwise(F.col("src")).alias("a"), "type", F.when(sym, F.greatest("src", "dst")).otherwise(F.col("dst")).alias("b"))


def existing_edges(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """JN4: distinct (a, type, b) of batch that are stored, either way round for symmetric types."""
    return _canonical(batch).distinct().join(_canonical(edges), ["a", "type", "b"], "left_semi")


def get(refs: DataFrame, nodes: DataFrame, name_keys: DataFrame) -> DataFrame:
    """AC2, JN5: (pos, id, found, family, kind, name, aliases) in the order of refs(pos, id); aliases are the node's other keys."""
    keys = name_keys.join(refs.select(F.col("id").alias("object_id")).distinct(), "object_id", "left_semi").groupBy("object_id").agg(F.array_sort(F.collect_set("raw")).alias("raws"))
    seen = refs.join(nodes, "id", "left").join(keys, F.col("id") == F.col("object_id"), "left")
    return seen.select("pos", "id", F.col("name").isNotNull().alias("found"), "family", "kind", "name", F.filter(F.coalesce("raws", F.array().cast("array<string>")), lambda r: r != F.col("name")).alias("aliases"))


def missing(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """SO4: refs that no node has."""
    return refs.join(nodes, "id", "left_anti")


def neighbours(ids: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN6: (id, other): one line a neighbour, `TYPE → name` or `TYPE ← name`, with the true direction."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.concat("type", F.lit(" → ")).alias("arrow"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("to"), F.concat("type", F.lit(" ← ")).alias("arrow"))
    names = nodes.select(F.col("id").alias("to"), "name")
    return out.unionByName(back).join(ids.select("id").distinct(), "id", "left_semi").join(names, "to").select("id", F.concat("arrow", "name").alias("other")).distinct()


def statements(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """JN7: (id, papers, n_neighbours): owning papers and neighbours of statements, each aggregated before they meet."""
    own = ids.select("id").distinct()
    papers = edges.filter("type = 'FROM'").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("papers"))
    around = edges.filter("type <> 'FROM'").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n_neighbours"))
    return own.join(papers, "id", "left").join(around, "id", "left").select("id", F.coalesce("papers", F.array().cast("array<string>")).alias("papers"), F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"))


def papers_by_shared_method(edges: DataFrame, method: str) -> DataFrame:
    """JN8: (paper, other): pairs of papers, a < b, joined by experiments that evaluate the same method as target and as baseline.

    All targets of a version meet all its baselines, and pairs are as many as their product: targets are cut into blocks of
    BLOCK_PAPERS, to each of which the baselines are sent, so no version fills a task. A pair of several versions is
    written in the least of them; the pairs themselves are neither shuffled nor sorted.
    """
    of = edges.filter((F.col("type") == "EVALUATES") & (F.col("dst") == method) & F.col("role").isin("target", "baseline") & F.col("version").isNotNull())
    paper = edges.filter("type = 'FROM'").select(F.col("src").alias("e"), F.col("dst").alias("paper"))
    members = settled(of.join(paper, F.col("src") == F.col("e")).groupBy("role", "paper").agg(F.collect_set("version").alias("vs")))
    targets, baselines = members.filter("role = 'target'").drop("role"), members.filter("role = 'baseline'").select(F.col("paper").alias("other"), F.col("vs").alias("ws"))
    blocks = targets.count() // BLOCK_PAPERS + 1
    one = lambda c: F.explode(c).alias("v")
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * blocks)
    left = targets.withColumn("block", F.pmod(F.xxhash64("paper"), F.lit(blocks))).select("paper", "vs", "block", one("vs")).repartition(parts, "v", "block")
    right = baselines.select("other", "ws", one("ws")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    first = F.array_min(F.array_intersect("vs", "ws"))
    return left.join(right, ["v", "block"]).filter((F.col("paper") < F.col("other")) & (F.col("v") == first)).select("paper", "other")


def shared_members(edges: DataFrame) -> DataFrame:
    """JN8, factorised: (method, version, paper, target, baseline): the papers of each method and version, once, with the roles their experiments give it.

    Every pair of papers that a path paper - experiment - method - experiment - paper joins is a target and a baseline of
    one group; as members of groups the pairs take as many rows as there are papers, however popular a method is.
    """
    of = edges.filter("type = 'EVALUATES'").select(F.col("src").alias("e"), F.col("dst").alias("method"), "version", "role")
    paper = edges.filter("type = 'FROM'").select(F.col("src").alias("e"), F.col("dst").alias("paper"))
    has = lambda role: F.max((F.coalesce(F.col("role"), F.lit("")) == role).cast("int"))
    return of.join(paper, "e").groupBy("method", "version", "paper").agg(has("target").alias("target"), has("baseline").alias("baseline")).filter("target + baseline > 0")


def shared_counts(members: DataFrame) -> DataFrame:
    """JN8: (method, version, n_targets, n_baselines, n_pairs) of shared_members; pairs are a target paper and a baseline paper after it, counted without writing them out."""
    return _counted(settled(members))


def shared_by_paper(members: DataFrame) -> DataFrame:
    """JN8: (method, version, paper, n_others, last_other): the pairs of shared_members counted by their target paper, of all groups, however many pairs these have."""
    rows = _with_others(settled(members)).filter("target = 1 and n_others > 0")
    return rows.select("method", "version", "paper", "n_others", "last_other")


def _with_others(members: DataFrame) -> DataFrame:
    """members that are written, with n_others, the baselines of the group behind each paper, and last_other, the last baseline of the group.

    For each paper it takes the baselines of later ranges of the group by their sums, and those of its own range by a running
    count, so no group fills a task and no pairs are formed. Cutting, summing and counting each read the members.
    """
    ranges = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), members.count() // RANGE_ROWS + 1)
    cut = settled(members.repartitionByRange(ranges, "method", "version", "paper").withColumn("range", F.spark_partition_id()))
    group = ["method", "version"]
    later = Window.partitionBy(*group).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*group, "range").agg(F.sum("baseline").alias("n"), F.max(F.when(F.col("baseline") == 1, F.col("paper"))).alias("last"))
    sums = sums.select(F.col("method").alias("m"), F.col("version").alias("v"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(later), F.lit(0)).alias("beyond"), F.max("last").over(Window.partitionBy(*group)).alias("last_other"))
    behind = F.coalesce(F.sum("baseline").over(Window.partitionBy(*group, "range").orderBy(F.desc("paper")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cut.withColumn("behind", behind).join(sums, F.col("method").eqNullSafe(F.col("m")) & F.col("version").eqNullSafe(F.col("v")) & (F.col("range") == F.col("r")))
    return rows.select(*members.columns, (F.col("behind") + F.col("beyond")).alias("n_others"), "last_other")


def _counted(members: DataFrame) -> DataFrame:
    """shared_counts of members that are written."""
    return _with_others(members).groupBy("method", "version").agg(F.sum("target").alias("n_targets"), F.sum("baseline").alias("n_baselines"), F.sum(F.col("target") * F.col("n_others")).alias("n_pairs"))


def shared_pairs(members: DataFrame, most: int | None = None) -> DataFrame:
    """JN8: (method, version, paper, other) with paper < other, every pair of shared_members; where `most` is asked for, of the groups of at most so many pairs.

    Targets of a group are cut into blocks of about BLOCK_PAPERS, to each of which its baselines are sent, so no group fills a task.
    """
    members = settled(members)
    same = F.col("method").eqNullSafe(F.col("m")) & F.col("version").eqNullSafe(F.col("v"))
    named = (F.col("method").alias("m"), F.col("version").alias("v"))
    sizes = members.groupBy("method", "version").agg(F.floor(F.sum("target") / BLOCK_PAPERS + 1).alias("blocks")) if most is None else _counted(members).filter(F.col("n_pairs") <= most).withColumn("blocks", F.floor(F.col("n_targets") / BLOCK_PAPERS + 1))
    own = members.join(sizes.select(*named, "blocks"), same).drop("m", "v")
    targets = own.filter("target = 1").withColumn("block", F.pmod(F.xxhash64("paper"), F.col("blocks")))
    other = own.filter("baseline = 1").select(*named, F.col("paper").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    return targets.join(other, same & (F.col("block") == F.col("b")) & (F.col("paper") < F.col("other"))).select("method", "version", "paper", "other")


def methods_with_models(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN9: (method, n_models, n_experiments), most models first; experiments are optional."""
    models = edges.filter("type = 'IMPLEMENTS'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_models"))
    tests = edges.filter("type = 'EVALUATES'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n_experiments"))
    return models.join(tests, "id", "left").join(nodes.select("id", "name"), "id").select(F.col("name").alias("method"), "n_models", F.coalesce("n_experiments", F.lit(0)).alias("n_experiments")).orderBy(F.desc("n_models"), "method")


def expand_down(seeds: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("PART_OF", "VERSION_OF"), depth: int = 2) -> DataFrame:
    """AC12: (root, id, depth): what is reached against the direction of `types` in up to `depth` steps, each id once at its least depth.

    A step is one join on the edges of these types. A level holds each (root, id) once, and none that a level before had: it
    grows with the ids reached, not with the paths to them, and circles end.
    """
    step = edges.filter(F.col("type").isin(*types)).select(F.col("dst").alias("at"), F.col("src").alias("next")).distinct()
    found = level = seeds.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        onward = level.join(step, F.col("id") == F.col("at")).select("root", F.col("next").alias("id")).distinct()
        level = onward.join(found, ["root", "id"], "left_anti").withColumn("depth", F.lit(d))
        level = settled(level) if 1 < d < depth else level  # else plans of deep expansions double with each level
        found = found.unionByName(level)
    return found


def experiments(subjects: DataFrame, edges: DataFrame, datasets: DataFrame, role: str = "evaluation_data") -> DataFrame:
    """AC4: (bucket, experiment, subject, dataset) of experiments on the subjects.

    `matched` use a wanted dataset in the wanted role, `role_missing` use one without a stated role, and `expandable` use
    only parts of a wanted dataset. datasets(id, depth) comes from `expand_down`; depth 0 is wanted itself. With a column root,
    the dataset asked for, each row tells for which one it holds.
    """
    root = [c for c in ("root",) if c in datasets.columns]
    on = edges.filter("type = 'EVALUATES'").join(subjects.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("experiment"), F.col("dst").alias("subject"))
    wanted = F.col("role") == role
    bucket = F.when(F.col("role").isNull(), "role_missing").when(wanted & (F.col("depth") == 0), "matched").when(wanted & (F.col("depth") > 0), "expandable")
    uses = edges.filter((F.col("type") == "USES") & (F.col("role").isNull() | wanted)).join(datasets.select(F.col("id").alias("dst"), "depth", *root), "dst").select(F.col("src").alias("experiment"), F.col("dst").alias("dataset"), bucket.alias("bucket"), *root).filter("bucket is not null")
    # each side holds a row once, so the pairs of an experiment do
    return on.distinct().join(uses.distinct(), "experiment").select("bucket", "experiment", "subject", "dataset", *root)


def bucket_counts(found: DataFrame) -> DataFrame:
    """AG23: distinct experiments and rows of each bucket."""
    return found.groupBy("bucket").agg(F.countDistinct("experiment").alias("n_experiments"), F.count(F.lit(1)).alias("n_rows"))


def context(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """AC6: (ref, role, other): the fixed patterns of each role around the refs, one join a role."""
    r = refs.select(F.col("id").alias("ref")).distinct()
    patterns = {
        "usage": ("EVALUATES", "dst", "src", None),
        "parts": ("PART_OF", "dst", "src", None),
        "whole": ("PART_OF", "src", "dst", None),
        "implementations": ("IMPLEMENTS", "dst", "src", None),
        "experiments": ("FROM", "dst", "src", None),
        "training": ("USES", "dst", "src", "training_data"),
        "evaluation": ("USES", "dst", "src", "evaluation_data"),
    }
    out = None
    for name, (kind, at, other, role) in patterns.items():
        e = edges.filter((F.col("type") == kind) & (F.lit(True) if role is None else F.col("role") == role))
        rows = r.join(e, r["ref"] == e[at]).select("ref", F.lit(name).alias("role"), F.col(other).alias("other")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def evidence(refs: DataFrame, edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """AC7: (ref, type, direction, other): relations of the given types one step away, both ways, with the true direction."""
    e = edges.filter(F.col("type").isin(*types))
    r = refs.select(F.col("id").alias("ref")).distinct()
    out = r.join(e, F.col("ref") == F.col("src")).select("ref", "type", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    back = r.join(e, F.col("ref") == F.col("dst")).select("ref", "type", F.lit("in").alias("direction"), F.col("src").alias("other"))
    return out.unionByName(back).distinct()


def implementations(methods: DataFrame, edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("Model", "Code")) -> DataFrame:
    """AC8: (method, resource, kind, name, n_identifiers) of the resources that implement the methods."""
    m = methods.select(F.col("id").alias("dst"))
    e = edges.filter("type = 'IMPLEMENTS'").join(m, "dst", "left_semi")
    return e.join(nodes.filter(F.col("kind").isin(*kinds)), F.col("src") == F.col("id")).select(F.col("dst").alias("method"), F.col("id").alias("resource"), "kind", "name", F.size("identifiers").cast("long").alias("n_identifiers"))


def library_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AG16: (what, label, n): nodes by family and kind, with totals by family and over all, and edges by type."""
    n = nodes.rollup("family", "kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), F.concat_ws(":", "family", "kind").alias("label"), "n")
    return n.unionByName(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), F.col("type").alias("label"), "n"))


def shared_identifiers(nodes: DataFrame) -> DataFrame:
    """AG17: identifiers that several nodes have, with their number and least and greatest member."""
    held = nodes.select("id", F.explode("identifiers").alias("identifier"))
    return held.groupBy("identifier").agg(F.countDistinct("id").alias("n_members"), F.min("id").alias("first_member"), F.max("id").alias("last_member")).filter("n_members > 1")


def integrity(nodes: DataFrame, name_keys: DataFrame, edges: DataFrame, content: tuple[str, ...] = ("experiment_",)) -> DataFrame:
    """AG18: one row of counts: nodes without a key, keys without a node, edge ends that are neither nodes nor content."""
    bare = nodes.join(name_keys, nodes["id"] == name_keys["object_id"], "left_anti").agg(F.count(F.lit(1)).alias("nodes_without_key"))
    loose = name_keys.join(nodes, nodes["id"] == name_keys["object_id"], "left_anti").agg(F.count(F.lit(1)).alias("keys_without_node"))
    ends = edges.select(F.col("src").alias("end")).union(edges.select("dst")).distinct()
    for c in content:
        ends = ends.filter(~F.col("end").startswith(c))
    dangling = ends.join(nodes, F.col("end") == nodes["id"], "left_anti").agg(F.count(F.lit(1)).alias("dangling_ends"))
    return bare.join(loose).join(dangling)  # three tables of one row each


def last_numbers(nodes: DataFrame) -> DataFrame:
    """AG24: the largest sequence number of each kind among ids of the form prefix_number."""
    number = F.regexp_extract("id", r"_[a-z]?(\d+)$", 1)
    return nodes.filter(number != "").groupBy("kind").agg(F.max(number.cast("long")).alias("last_number"))


def allocate(batch: DataFrame, last: DataFrame, prefixes: Column) -> DataFrame:
    """WN3: batch(kind, pos) with new ids, numbered on from each kind's last in the order of pos.

    Rows are numbered inside sampled ranges of (kind, pos), and ranges by the sums before them, so no kind fills a task.
    """
    ranges = max(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), batch.count() // RANGE_ROWS + 1)
    cut = settled(batch.select("kind", "pos").repartitionByRange(ranges, "kind", "pos").withColumn("range", F.spark_partition_id()))
    ahead = Window.partitionBy("kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("kind", "range").agg(F.count(F.lit(1)).alias("n")).select("kind", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy("kind", "range").orderBy("pos")) + F.col("before") + F.coalesce("last_number", F.lit(0))
    return cut.join(before, ["kind", "range"]).join(last, "kind", "left").select("kind", "pos", F.format_string("%s_%04d", prefixes, n).alias("new_id"))


def follow_merges(merged: DataFrame) -> DataFrame:
    """AC17: (id, survivor): the end of each chain of merged(id, into), by doubling the step until nothing moves.

    Each round is written, so the plan does not grow. What still moves after more rounds than any chain needs is a circle.
    """
    at = settled(merged.select("id", "into"))
    left = at.count().bit_length() + 2
    while True:
        nxt = at.select(F.col("id").alias("n"), F.col("into").alias("n_into"))
        moved = at.join(nxt, F.col("into") == F.col("n"), "left").select("id", F.coalesce("n_into", "into").alias("into"), (F.col("n").isNotNull() & (F.col("n_into") != F.col("into"))).alias("moved"))
        moved = settled(moved)
        at = moved.drop("moved")
        if not moved.filter("moved").take(1):
            break
        left -= 1
        if not left:
            raise ValueError("merges form a circle")
    if at.filter(F.col("id") == F.col("into")).take(1):  # circles of 2, 4, 8 ... end at themselves
        raise ValueError("merges form a circle")
    return at.select("id", F.col("into").alias("survivor"))


def page_of(rows: DataFrame, after: Column | None, order: str, size: int) -> DataFrame:
    """AC18: the next `size` rows by the order key beyond the last key seen, with a flag if more follow."""
    rest = rows if after is None else rows.filter(F.col(order) > after)
    more = rest.orderBy(order).limit(size + 1).withColumn("n", F.row_number().over(Window.orderBy(order)))
    return more.withColumn("more", F.max("n").over(Window.partitionBy()) > size).filter(F.col("n") <= size).drop("n")
