"""AC6: what stands around given nodes, by logical roles that are filled in the order in which they depend on each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.graph import expand_down
from quillmesh.session import settled

#: The roles in the order of their dependencies.
ROLES = ("definition", "source_contents", "usage", "descriptions", "answers", "expressions", "discussed_objects", "experiments", "versions", "parts", "observations", "checked_claims", "protocol", "participants", "sources")
#: Roles of contents: the edge from a content to the node, the family of the node, and the kind of the content.
CONTENTS = {
    "source_contents": ("FROM", "Entity", None),
    "usage": ("ABOUT", None, "usage"),
    "descriptions": ("ABOUT", None, "description"),
    "answers": ("RESPONDS_TO", "Concept", None),
    "expressions": ("EXPRESSES", "Concept", None),
}
TAKING_PART = ("EVALUATES", "USES", "MEASURED_BY", "USES_PROTOCOL")
ROW = ("ref", "other", "via", "way")
#: What a start leads on to, and how it was found, as bits: several roles share one join.
CONTENT, EXPERIMENT, PROTOCOL, SOURCE, CHECK, EVALUATED, OBSERVED = (1 << i for i in range(7))
#: The most rows of sources of ends that are broadcast.
FEW = 50_000


def roles_around(refs: DataFrame, nodes: DataFrame, edges: DataFrame, roles: tuple[str, ...] = ROLES, depth: int = 1) -> DataFrame:
    """AC6: (ref, role, other, via, way), each row once: for each node of refs(id) what fills the asked roles.

    nodes(id, family, kind), edges(src, type, dst). `via` is the record through which `other` was found, null where the edge
    meets the node itself; `way` is the type of the last edge, `self` for the node itself. Contents, experiments and observations that
    asked roles bring in are what later roles start from; roles that are not asked bring in nothing, but checked claims look
    through observations in any case. versions and parts go `depth` steps down. The order in which roles are named changes nothing; an unknown
    role is an error. Refs without a node, and edges to ids without one, count as far as no family or kind is asked.
    """
    if unknown := set(roles) - set(ROLES):
        raise ValueError(f"no such roles: {sorted(unknown)}")
    known = nodes.select(F.col("id").alias("ref"), "family", "kind").distinct()
    own = refs.select(F.col("id").alias("ref")).distinct()
    typed = own.join(known, "ref", "left")
    of_type = lambda *types: edges.filter(F.col("type").isin(*types)).select("src", F.col("type").alias("way"), "dst")
    none, itself = F.lit(None).cast("string"), F.lit("self").alias("way")
    asked = lambda *names: any(n in roles for n in names)
    found, starts = [], [typed.select("ref", F.col("ref").alias("at"), none.alias("via"), _bits((PROTOCOL | SOURCE, F.lit(True)), (CONTENT, F.col("family") == "Content"), (EXPERIMENT, F.col("kind") == "Experiment")))]

    def add(role: str, df: DataFrame) -> None:
        found.append(df.select(*ROW, F.lit(role).alias("role")))

    def through(df: DataFrame, bits: int, elsewhere: int = 0) -> None:
        """Later roles start from what df(ref, other) found, some only where it is not the ref itself."""
        starts.append(df.select("ref", F.col("other").alias("at"), F.col("other").alias("via"), _bits((bits, F.lit(True)), (elsewhere, F.col("other") != F.col("ref")))))

    if "definition" in roles:
        add("definition", typed.filter("family = 'Concept'").select("ref", F.col("ref").alias("other"), none.alias("via"), itself).distinct())
    contents = None
    if asked(*CONTENTS):
        role = F.lit(None).cast("string")
        for name, (kind, family, of_kind) in CONTENTS.items():
            if name in roles:
                fits = (F.col("way") == kind) & (F.lit(True) if family is None else F.col("family") == family) & (F.lit(True) if of_kind is None else F.col("content_kind") == of_kind)
                role = F.coalesce(role, F.when(fits, name))
        content = known.filter("family = 'Content'").select(F.col("ref").alias("src"), F.col("kind").alias("content_kind"))
        pointing = of_type(*{CONTENTS[n][0] for n in CONTENTS if n in roles}).join(content, "src").join(typed, F.col("dst") == F.col("ref"))
        # several roles start from the contents: they are worked out once
        contents = settled(pointing.select("ref", F.col("src").alias("other"), none.alias("via"), "way", role.alias("role")).filter("role is not null").distinct())
        found.append(contents.select(*ROW, "role"))
        through(contents, CONTENT, SOURCE)
    if "experiments" in roles:
        known_contents = typed.filter("family = 'Content'").select("ref", F.col("ref").alias("at"))
        if contents is not None:
            known_contents = known_contents.unionByName(contents.select("ref", F.col("other").alias("at")))
        supported = settled(known_contents.distinct().join(of_type("SUPPORTED_BY").distinct(), F.col("at") == F.col("src")).select("ref", F.col("dst").alias("other"), F.col("at").alias("via"), "way"))
        own_experiments = typed.filter("kind = 'Experiment'").select("ref", F.col("ref").alias("other"), none.alias("via"), itself).distinct()
        add("experiments", supported)
        add("experiments", own_experiments)
        through(supported, PROTOCOL, EXPERIMENT | SOURCE)
        through(own_experiments, PROTOCOL)
    into = lambda kind: own.join(of_type(kind), F.col("ref") == F.col("dst")).select("ref", F.col("src").alias("other"))
    if "experiments" in roles:
        through(into("EVALUATES"), PROTOCOL | EVALUATED, EXPERIMENT | SOURCE)
    if asked("observations", "checked_claims"):
        if "observations" in roles:
            through(into("OBSERVES"), PROTOCOL | OBSERVED | CHECK, SOURCE)
        else:
            through(into("OBSERVES"), CHECK)
    below = []
    for name, kind in (("versions", "VERSION_OF"), ("parts", "PART_OF")):
        if name in roles:
            down = expand_down(own.select(F.col("ref").alias("id")), edges, (kind,), depth).filter("depth > 0").select(F.col("root").alias("ref"), F.col("id").alias("other"), none.alias("via"), F.lit(kind).alias("way"))
            add(name, down)
            below.append(down)

    # every start once, with all that starts from it; the exchange by `at` serves both joins below
    start = joined(starts).repartition("at").groupBy("ref", "at", "via").agg(F.bit_or("bits").alias("bits"))
    for name, bit, kind in (("experiments", EVALUATED, "EVALUATES"), ("observations", OBSERVED, "OBSERVES")):
        if name in roles:
            add(name, start.filter(_has(bit)).select("ref", F.col("at").alias("other"), none.alias("via"), F.lit(kind).alias("way")))
    onward = [(n, bit, kinds) for n, bit, kinds in (("discussed_objects", CONTENT, ("ABOUT",)), ("checked_claims", CHECK, ("CHECKS",)), ("protocol", PROTOCOL, ("USES_PROTOCOL",)), ("participants", EXPERIMENT, TAKING_PART)) if n in roles]
    led = lambda n, bit, kinds: F.when(F.col("way").isin(*kinds) & _has(bit), n)
    if onward:
        steps = of_type(*{k for _, _, kinds in onward for k in kinds})
        met = start.join(steps.repartition("src").distinct(), F.col("at") == F.col("src"))
        found.append(met.select("ref", F.col("dst").alias("other"), "via", "way", F.explode(F.array_compact(F.array(*[led(*o) for o in onward]))).alias("role")))
    if "sources" in roles:
        direct = of_type("FROM").select("src", "way", none.alias("mid"), F.col("dst").alias("source"))
        ends = [steps.select(F.col("dst").alias("mid"))] if onward else []
        ends += [edges.filter(F.col("type") == kind).select(F.col("src").alias("mid")) for n, kind in (("versions", "VERSION_OF"), ("parts", "PART_OF")) if n in roles]
        sourced = []
        if ends:
            # what the sources of these roles' ends are is joined to the edges, not to the pairs
            reached = settled(of_type("FROM").select(F.col("src").alias("mid"), F.col("dst").alias("source")).distinct().join(joined(ends).distinct(), "mid", "left_semi"))
            reached = F.broadcast(reached) if reached.count() <= FEW else reached
            if onward:
                direct = direct.unionByName(steps.join(reached, F.col("dst") == F.col("mid")).select("src", "way", "mid", "source"))
            sourced = [b.join(reached, F.col("other") == F.col("mid")).select("ref", F.col("mid").alias("via"), "source") for b in below]
        met = start.join(direct.repartition("src").distinct(), F.col("at") == F.col("src"))
        leads = ((F.col("way") == "FROM") & _has(SOURCE)) if not onward else ((F.col("way") == "FROM") & _has(SOURCE)) | F.coalesce(*[led(*o) for o in onward]).isNotNull()
        sourced.append(met.filter(leads).select("ref", F.coalesce("mid", "via").alias("via"), "source"))
        sources = joined(sourced).filter("via is null or via <> ref").distinct()
        add("sources", sources.select("ref", F.col("source").alias("other"), "via", F.lit("FROM").alias("way")))
    if not found:
        return own.limit(0).select("ref", F.lit("").alias("role"), F.col("ref").alias("other"), none.alias("via"), none.alias("way"))
    return joined(found).select("ref", "role", "other", "via", "way")


def joined(parts: list[DataFrame]) -> DataFrame:
    """All rows of parts."""
    return reduce(DataFrame.unionByName, parts)


def _bits(*given: tuple[int, Column]) -> Column:
    return reduce(Column.bitwiseOR, [F.when(where, bit).otherwise(0) for bit, where in given]).alias("bits")


def _has(bit: int) -> Column:
    return F.col("bits").bitwiseAND(bit) != 0
