"""Quality rules with robust multivariate outliers, in DataFrame functions throughout.

Base rules reject very short and very repetitive texts. Beyond them, each text has a vector of transformed statistics; for
every language and source a minimum-covariance-determinant estimate is found by concentration steps: keep the three
quarters of the rows that lie nearest, take their mean and covariance, and repeat until the determinant stops falling.
Several starts are followed and the one of least determinant counts. Estimates are nested: all rows, a language, a language
and source; each counts the estimate above it as PRIOR_ROWS rows more, so small groups lean on it and large ones hardly do.
A row whose Mahalanobis distance from its group is beyond the cut-off is rejected. All steps are grouped sums and quantile
sketches, which combine before the shuffle, so a group with a third of the rows costs no task more than others.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import NONSPACE_WORD, fits, materialize, nonspace_words, rows_of

RUN = 8
CORE = 0.75
#: The weight in rows of the estimate above: about four rows for each of the fifteen figures of a covariance.
PRIOR_ROWS = 60.0
#: The 99.9 % quantile of chi2_5.
CUTOFF = 20.515
#: A step that lowers the logarithm of the determinant by less is the last; it is bounded below by FLOORS, so steps end.
LEAST_FALL = 1e-6
BROADCAST_GROUPS = 100_000
#: For five dimensions and the nearest three quarters: CORE / P(chi2_7 <= chi2_5 quantile of CORE).
CONSISTENCY = 1.41
#: Least standard deviations of the five statistics, which also keep covariances of constant ones regular. Each can reject
#: alone: in a group without any spread, 29 % of duplicate lines are beyond the cut-off, or 18 % of repeated words.
FLOORS = (0.08, 0.25, 0.75, 0.4, 0.65)
D = len(FLOORS)
GROUP = ("g_lang", "g_source")
MEANS = [f"m{i}" for i in range(D)]
FACTOR = [f"l{i}{j}" for i in range(D) for j in range(i + 1)]


def let(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def repeated_words(words: Column, run: int = RUN) -> Column:
    """How many words lie in runs of `run` words that stand twice or more in the array, the first ones included."""
    n = F.size(words)
    hashes = F.when(n >= run, F.transform(F.sequence(F.lit(0), F.greatest(n - run, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(run)])))

    def places(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        again = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(let(ordered, again), lambda x: x["p"]))

    def covered(p):
        steps = F.transform(p, lambda x, i: F.least(F.lit(run), x - F.coalesce(F.get(p, i - 1), x - run)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(hashes, lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(let(places(h), covered)))


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, __k, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals)."""
    rows = rows_of(docs, "text", "lang", "source").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("words", nonspace_words(F.col("text")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(NONSPACE_WORD)))
    return rows.select(
        "doc_id",
        "__k",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_capitals"),
    )


def statistics(counts: DataFrame) -> DataFrame:
    """counts with base_failed and the five transformed statistics x0 to x4."""
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    x = [
        F.log(chars / words),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(100 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(5))),
        F.log1p(100 * F.col("n_capitals") / chars),
        F.log1p(100 * F.col("n_repeat_words") / words),
    ]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumns({f"x{i}": c.cast("double") for i, c in enumerate(x)})


def _with_groups(rows: DataFrame, groups: DataFrame, how: str = "inner", by: tuple[str, ...] = GROUP) -> DataFrame:
    """rows with the columns of their group; the table of groups is broadcast only if it is small."""
    g = groups.withColumnsRenamed({c: f"__{c}" for c in by})
    g = F.broadcast(g) if fits(g, BROADCAST_GROUPS) else g
    return rows.join(g, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]), how).drop(*[f"__{c}" for c in by])


def _distance(mean: list[Column], chol: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i in range(D):
        rest = F.col(f"x{i}") - mean[i]
        for k in range(i):
            rest = rest - chol[i][k] * y[k]
        y.append(rest / chol[i][i])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factor(groups: DataFrame, by: tuple[str, ...], prior: DataFrame | None = None) -> DataFrame:
    """Mean m0.. and Cholesky factor l00.. of each group of sums, column by column of the factor so that no expression is long.

    prior has the mean and factor of the estimate above each group; they count as PRIOR_ROWS rows.
    """
    if prior is not None:
        above = prior.select(*GROUP, *[F.col(c).alias(f"p_{c}") for c in (*MEANS, *FACTOR)])
        groups = _with_groups(groups, above)
        own = {"n": F.col("n") + PRIOR_ROWS} | {f"s{i}": F.col(f"s{i}") + PRIOR_ROWS * F.col(f"p_m{i}") for i in range(D)}
        for i in range(D):
            for j in range(i + 1):
                cov = sum((F.col(f"p_l{i}{k}") * F.col(f"p_l{j}{k}") for k in range(j + 1)), F.lit(-(FLOORS[i] ** 2) if i == j else 0.0))
                cov = F.greatest(cov, F.lit(0.0)) if i == j else cov
                own[f"s{i}{j}"] = F.col(f"s{i}{j}") + PRIOR_ROWS * (cov / CONSISTENCY + F.col(f"p_m{i}") * F.col(f"p_m{j}"))
        groups = groups.select(*by, *[c.alias(name) for name, c in own.items()])
    mean = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(D)}
    out = groups.withColumns(mean)
    for i in range(D):
        for j in range(i + 1):
            cov = CONSISTENCY * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + F.lit(FLOORS[i] ** 2)
            for k in range(j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(FLOORS[i] ** 2 / 100))) if i == j else cov / F.col(f"l{j}{j}"))
    return out.select(*by, *MEANS, *FACTOR).withColumn("log_det", _log_det())


def _log_det() -> Column:
    """The logarithm of the determinant of a covariance, from its factor."""
    return sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(D)), F.lit(0.0))


def _sums() -> list[Column]:
    """The sums that _factor takes."""
    return [F.count(F.lit(1)).alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(D) for j in range(i + 1)]


def _starts(used: DataFrame) -> DataFrame:
    """Three models of each group: medians with absolute deviations, mean and covariance of all rows, and lower quartiles
    with their distance from the median, for statistics that outliers raise only."""
    mid = materialize(used.groupBy(*GROUP).agg(*[F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5)), 10_000).alias(f"q{i}") for i in range(D)]), "quartiles")
    off = _with_groups(used, mid).groupBy(*GROUP).agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"q{i}")[1]), 0.5, 10_000).alias(f"a{i}") for i in range(D)])
    both = materialize(_with_groups(mid, off), "spreads")
    found = _factor(used.groupBy(*GROUP).agg(*_sums()), GROUP).withColumn("start", F.lit(1))
    for k, at, spread in ((0, 1, lambda i: 1.4826 * F.col(f"a{i}")), (2, 0, lambda i: F.col(f"q{i}")[1] - F.col(f"q{i}")[0])):
        factor = [(F.greatest(spread(i), F.lit(FLOORS[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(D) for j in range(i + 1)]
        found = found.unionByName(both.select(*GROUP, *[F.col(f"q{i}")[at].alias(f"m{i}") for i in range(D)], *factor).withColumn("log_det", _log_det()).withColumn("start", F.lit(k)))
    return found


def least_determinant(used: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Mean and factor of each group of used(g_lang, g_source, x0..x4): C-steps from every start until none lowers the
    determinant, and of the ends the one of least determinant. prior has the estimate above each group."""
    by = (*GROUP, "start")
    # a start is not the estimate of three quarters of the rows, so the first step always counts
    model = materialize(_starts(used).withColumns({"log_det": F.lit(float("inf")), "moving": F.lit(True)}), "start")
    dist = _distance([F.col(m) for m in MEANS], [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(D)])
    while model.filter("moving").take(1):
        at = _with_groups(used, model.filter("moving")).select(*by, *[f"x{i}" for i in range(D)], dist.alias("dist"))
        near = _with_groups(at, at.groupBy(*by).agg(F.percentile_approx("dist", CORE, 10_000).alias("reach")), by=by).filter("dist <= reach")
        new = materialize(_factor(near.groupBy(*by).agg(*_sums()), by, prior), "step")
        columns = [*MEANS, *FACTOR, "log_det"]
        both = _with_groups(model, new.withColumnsRenamed({c: f"new_{c}" for c in columns}), "left", by)
        fell = F.coalesce(F.col("new_log_det") < F.col("log_det") - LEAST_FALL, F.lit(False))
        model = materialize(both.select(*by, *[F.when(fell, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns], fell.alias("moving")), "model")
    best = model.groupBy(*GROUP).agg(F.min(F.struct("log_det", "start", *MEANS, *FACTOR)).alias("best"))
    return materialize(best.select(*GROUP, *[F.col(f"best.{c}") for c in (*MEANS, *FACTOR)]), "least")


def nested_estimates(used: DataFrame) -> DataFrame:
    """Mean and factor of each language and source of used: first of all rows, then of languages, then of these groups."""
    keys = materialize(used.select(*GROUP).distinct(), "groups")
    model, above = None, ()
    for known in ((), ("g_lang",), GROUP):
        level = lambda df, by: df.withColumns({g: F.lit("") for g in GROUP if g not in by})
        prior = None
        if model is not None:  # the model of the level above, under the keys of this one
            here = level(keys, known).distinct().withColumns({f"own_{g}": F.col(g) for g in GROUP})
            prior = _with_groups(level(here, above), model).select(*[F.col(f"own_{g}").alias(g) for g in GROUP], *MEANS, *FACTOR)
            prior = materialize(prior, "prior")
        model, above = least_determinant(level(used, known), prior), known
    return model


def robust_distances(rows: DataFrame) -> DataFrame:
    """rows, with x0 to x4, lang and source, and dist, the squared robust distance from their group."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?"))  # noqa: E731  # null is a value of its own
    rows = materialize(rows.withColumns({"g_lang": mark("lang"), "g_source": mark("source")}), "statistics")
    names = [c for c in rows.columns if c not in GROUP]
    dist = _distance([F.col(m) for m in MEANS], [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(D)])
    return _with_groups(rows, nested_estimates(rows.filter("n_words > 0")), "left").select(*names, dist.alias("dist"))


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, __k, the base counts, base_failed, dist and kept for every row of docs.

    kept is false if a base rule fails or if the squared distance is beyond the cut-off. Null and empty texts have no words and fail.
    Null languages and sources are values of their own. Rows repeated exactly count each time and fare alike; long texts
    are counted whole; columns besides doc_id, text, lang and source are ignored, whatever their names; an empty table gives
    an empty one. Quartiles and cut-offs of steps come from quantile sketches, exact to a ten-thousandth of a group's rows.
    """
    rows = robust_distances(statistics(base_counts(docs)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("dist", F.lit(0.0)) <= cutoff))


def quality_rules_digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract, and the distance."""
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("dist").alias("distance"))
