"""ST38: the figures of papers with the files of their pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import tex
from quillmesh.functions import text as t

# Endings of pictures, in the order in which they are tried.
ENDINGS = (".pdf", ".png", ".jpg", ".jpeg", ".eps", ".svg")


def _trimmed(path: Column) -> Column:
    """A path without dots and slashes at its ends, and without empty steps."""
    return F.regexp_replace(F.regexp_replace(path, r"/(?:\.?/)+", "/"), r"^[./]+|[./]+$", "")


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _ending(path: Column) -> Column:
    return F.regexp_extract(_base(path), r"^.+(\.[^.]+)$", 1)


def figure_files(sources: DataFrame, files: DataFrame, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """ST38: one row a picture of a figure: (package, n, figure_id, label, caption, environment, file, k, role, status, path, output, reason).

    sources(package, main, source) are put together as `assembled` does, files(package, name) are the packages' files. A picture
    is looked for at the top, beside the file that its figure stands in, and in the folders of \\graphicspath, as written or else with each
    ending; the first that is there counts, otherwise the only file of such a base name. `output` is where a copy goes. A figure
    without a picture has one row of status missing. A figure counts to the file that was included last before it. Packages without a name are left out, files of one name count once.
    """
    read = sources.filter("package is not null").select("package", "main", tex.tex_figures(F.col("source")).alias("x"))
    figs = read.select("package", "main", F.col("x.folders").alias("folders"), F.explode("x.figures").alias("f")).select("package", "main", "folders", "f.*")
    named = figs.withColumn("file", F.when(F.col("file") == "", F.col("main")).otherwise(F.col("file")))
    label = F.coalesce(F.nullif(t.slug(F.when(F.col("label") != "", F.col("label_text")).otherwise(F.concat(F.lit("figure-"), "n"))), F.lit("")), F.lit("unknown"))
    pictures = named.select("package", "n", F.concat(F.lit("fig::"), label).alias("figure_id"), "label", "caption", "environment", "file", "folders", F.posexplode_outer("pictures").alias("k", "raw"))

    tried = F.when(_ending(F.col("raw")) != "", F.array(F.lit(""))).otherwise(F.array(*[F.lit(e) for e in endings]))
    beside = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    places = F.concat(F.array(F.lit(""), beside), F.transform("folders", _trimmed))
    names = F.flatten(F.transform(places, lambda d: F.transform(tried, lambda e: _trimmed(F.concat(F.when(d == "", F.lit("")).otherwise(F.concat(d, F.lit("/"))), F.col("raw"), e)))))
    wanted = pictures.filter("raw is not null").select("package", "n", "k", F.posexplode(names).alias("place", "at"))
    own = files.filter("package is not null and name is not null").select("package", "name").distinct()
    here = wanted.join(own.select("package", "name", _trimmed(F.col("name")).alias("at")), ["package", "at"])
    direct = here.groupBy("package", "n", "k").agg(F.min(F.struct("place", "name"))["name"].alias("direct"))
    bases = pictures.filter("raw is not null").select("package", "n", "k", F.explode(F.transform(tried, lambda e: F.concat(_base(F.col("raw")), e))).alias("base"))
    only = bases.join(own.select("package", "name", _base(F.col("name")).alias("base")), ["package", "base"]).groupBy("package", "n", "k").agg(F.count(F.lit(1)).alias("c"), F.min("name").alias("only")).filter("c = 1").drop("c")

    found = pictures.join(direct, ["package", "n", "k"], "left").join(only, ["package", "n", "k"], "left").withColumn("there", F.coalesce("direct", "only"))
    role = F.when(F.col("raw").isNull(), "unknown").when(F.col("k") == 0, "primary").otherwise("subfigure")
    ending = F.coalesce(F.nullif(_ending(F.col("there")), F.lit("")), F.lit(".asset"))
    output = F.when(F.col("there").isNotNull(), F.concat(F.lit("figures/"), F.format_string("fig_%03d_", "n"), F.substring("figure_id", 6, 1_000_000), ending)).otherwise("")
    reason = F.when(F.col("raw").isNull(), "no picture in the figure").when(F.col("there").isNull(), F.concat(F.lit("no file for "), "raw"))
    status = F.when(F.col("there").isNotNull(), "copied").otherwise("missing")
    return found.select("package", "n", "figure_id", "label", "caption", "environment", "file", (F.coalesce("k", F.lit(0)) + 1).alias("k"), role.alias("role"), status.alias("status"), F.coalesce("there", "raw", F.lit("")).alias("path"), output.alias("output"), reason.alias("reason"))


def figure_totals(found: DataFrame) -> DataFrame:
    """ST38: figures, copied and missing pictures of each package that has a figure."""
    return found.groupBy("package").agg(F.max("n").cast("long").alias("n_figures"), F.count_if(F.col("status") == "copied").alias("n_copied"), F.count_if(F.col("status") == "missing").alias("n_missing"))
