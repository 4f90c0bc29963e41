"""Records: logs with a last word, replacements, staleness, priorities, budgets, three-valued conditions and batch rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """SK4, SK6: the last entry of each key; a maximum of structs combines before the shuffle, unlike a window."""
    rest = [c for c in log.columns if c != key and c not in order]
    best = log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}") for c in (*order, *rest)])


def replaced(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """SK2: base with the rows of changes in place of those of the same key, and new keys added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes.select(*base.columns))


def overridden(base: DataFrame, *sources: DataFrame, key: str, value: str) -> DataFrame:
    """JN11, DC16: (key, value, source) by the first source that has the key; keys of base that no source has are dropped."""
    out = base.select(key)
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"v{i}")), key, "left")
    values = [F.col(f"v{i}") for i in range(len(sources))]
    pick = reduce(lambda w, i: w.when(values[i].isNotNull(), i), range(1, len(values)), F.when(values[0].isNotNull(), 0))
    return out.select(key, F.coalesce(*values).alias(value), pick.alias("source")).filter(F.col(value).isNotNull())


def stale(current: DataFrame, stored: DataFrame, key: str, print_: str) -> DataFrame:
    """SK5: rows of current whose fingerprint is not the stored one, new rows included."""
    old = stored.select(key, F.col(print_).alias("__old"))
    return current.join(old, key, "left").filter(~F.col(print_).eqNullSafe(F.col("__old"))).drop("__old")


def within_budget(rows: DataFrame, partition: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """TK8, AC9: rows in order as long as their running size stays within the budget."""
    upto = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(upto)).filter(F.col("used") <= budget)


def conjunction(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """PF16: any false makes false, all true makes true, otherwise unknown (null)."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.when(F.count_if(~v) > 0, False).when(F.count_if(v) == F.count(F.lit(1)), True).alias("value"))


def same_version(a: Column, b: Column) -> Column:
    """PF17: true if both are known and equal up to case and a leading v; otherwise unknown, never false."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^v", "")
    return F.when(plain(a) == plain(b), True)


def violations(nodes: DataFrame, kinds: dict[str, tuple[str, ...]], namespaces: tuple[str, ...]) -> DataFrame:
    """PF2: (ref, rule) for every broken rule of a batch of nodes(ref, family, kind, name, identifiers); one pass for the rules of single rows."""
    allowed = F.lit(False)
    for family, of in kinds.items():
        allowed |= (F.col("family") == family) & F.col("kind").isin(*of)
    ids = F.coalesce("identifiers", F.array().cast("array<string>"))
    single = {
        "kind-not-allowed": ~F.coalesce(allowed, F.lit(False)),
        "name-missing": F.coalesce(F.trim("name"), F.lit("")) == "",
        "bar-in-name": F.coalesce(F.contains("name", F.lit("|")), F.lit(False)),
        "unknown-namespace": F.exists(ids, lambda i: ~F.substring_index(i, ":", 1).isin(*namespaces)),
    }
    rules = nodes.select("ref", F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in single.items()]))).alias("rule"))
    twice = nodes.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ref", F.lit("duplicate-ref").alias("rule"))
    shared = nodes.select("ref", F.explode(ids).alias("i")).filter(F.substring_index("i", ":", 1) != "url").groupBy("i").agg(F.collect_set("ref").alias("refs")).filter(F.size("refs") > 1)
    return rules.unionByName(twice).unionByName(shared.select(F.explode("refs").alias("ref"), F.lit("duplicate-identifier").alias("rule"))).distinct()


def best_tier(candidates: DataFrame, key: str, tier: Column, order: str) -> DataFrame:
    """JN30: of each key the candidate of the least tier, and of these the first; candidates without a tier do not count."""
    rest = [c for c in candidates.columns if c != key]
    best = candidates.withColumn("__tier", tier).filter("__tier is not null").groupBy(key).agg(F.min(F.struct("__tier", order, *[c for c in rest if c != order])).alias("b"))
    return best.select(key, F.col("b.__tier").alias("tier"), *[F.col(f"b.{c}") for c in rest])


def agreement(pairs: DataFrame, ours: str, theirs: str) -> DataFrame:
    """AG12: one row: pairs, those that have ours, those that agree, and recall to three places; null without pairs."""
    n, matched = F.count(F.lit(1)), F.count(ours)
    return pairs.agg(n.alias("n"), matched.alias("matched"), F.count_if(F.col(ours) == F.col(theirs)).alias("agree"), F.round(matched / F.nullif(n, F.lit(0)), 3).alias("recall"))


def comparable_pairs(rows: DataFrame, group: str, item: str, conditions: dict[str, Column], value: str) -> DataFrame:
    """AC13: (group, a, b, comparable, difference) of two results of one request: any condition that differs makes them
    incomparable, all equal make them comparable, otherwise it is unknown; only comparable values are subtracted.

    conditions name columns of rows; `version` follows same_version. Pairs stay within a request, whose results are few.
    """
    plain = rows.select(group, item, value, *[c.alias(f"c_{name}") for name, c in conditions.items()])
    left, right = (plain.select(group, *[F.col(c).alias(f"{side}_{c}") for c in plain.columns if c != group]) for side in "ab")
    met = left.join(right, group).filter(F.col(f"a_{item}") < F.col(f"b_{item}"))
    one = lambda name: same_version(F.col(f"a_c_{name}"), F.col(f"b_c_{name}")) if name == "version" else F.col(f"a_c_{name}") == F.col(f"b_c_{name}")
    verdict = reduce(lambda x, y: x & y, [one(name) for name in conditions])  # three-valued: false wins, then unknown
    pairs = met.withColumn("comparable", verdict)
    return pairs.select(group, F.col(f"a_{item}").alias("a"), F.col(f"b_{item}").alias("b"), "comparable", F.when(F.col("comparable"), F.col(f"a_{value}") - F.col(f"b_{value}")).alias("difference"))
