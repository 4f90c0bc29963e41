"""Papers from their sources: references of packages, Markdown reference lists, citations met with references, logs and reports."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import citations as ct
from quillmesh.functions import tex
from quillmesh.functions import text as t
from quillmesh.operators import bibliography as b
from quillmesh.operators import graph, retrieval

PREVIEW = 2000
_SENTENCE_END = r"[.!?。)]\s*$"


def package_references(files: DataFrame) -> DataFrame:
    """ST28: one entry a (package, key) of files(package, name, content): of .bib files, or of .bbl files where no .bib has any.

    Of entries with one key the last counts, by file name and then by place; source is the first file that has entries.
    """
    read = files.select("package", "name", F.posexplode(tex.references(F.col("name"), F.col("content"))).alias("pos", "e"))
    tagged = read.select("package", "name", "pos", F.col("name").endswith(".bbl").alias("bbl"), "e.*")
    package = Window.partitionBy("package")
    kept = tagged.withColumn("least", F.min("bbl").over(package)).filter(F.col("bbl") == F.col("least"))
    last = F.row_number().over(Window.partitionBy("package", "key").orderBy(F.desc("name"), F.desc("pos")))
    placed = kept.withColumns({"source": F.min("name").over(package), "back": last}).filter("back = 1")
    return placed.drop("name", "pos", "bbl", "least", "back")


def markdown_references(lines: Column) -> Column:
    """WN5b: the entries of the lines of a reference list.

    A line that looks like a start begins an entry after a blank line, or where what is gathered has a year and ends like a
    sentence; other lines are joined to what is gathered. Null lines are blank, and null lists have no entries. The list is first
    cut where a line begins an entry whatever was gathered before: after a blank line, or after one that has a year and such an
    end itself. What is gathered is then copied within such a piece only, so the time grows with the list.
    """
    state = F.struct(F.array().cast("array<string>").alias("entries"), F.lit("").alias("current"), F.lit(True).alias("blank"))

    def step(acc: Column, line: Column) -> Column:
        whole = acc["current"].rlike(t.YEAR) & acc["current"].rlike(_SENTENCE_END)
        fresh = (acc["current"] != "") & t.looks_like_start(line) & (acc["blank"] | whole)
        return F.when(line == "", F.struct(acc["entries"].alias("entries"), acc["current"].alias("current"), F.lit(True).alias("blank"))).otherwise(
            F.struct(
                F.when(fresh, F.array_append(acc["entries"], acc["current"])).otherwise(acc["entries"]).alias("entries"),
                F.when(fresh, line).otherwise(t.join_fragments(acc["current"], line)).alias("current"),
                F.lit(False).alias("blank"),
            )
        )

    end = lambda acc: F.when(acc["current"] != "", F.array_append(acc["entries"], acc["current"])).otherwise(acc["entries"])

    def entries(of: Column) -> Column:
        def begins(i: Column) -> Column:
            before = F.get(of, i - 1)
            # a year behind a blank or bracket stays one, whatever the line is joined to
            return (i > 0) & t.looks_like_start(F.get(of, i)) & ((before == "") | (before.rlike("[ (]" + t.YEAR) & before.rlike(_SENTENCE_END)))

        places = F.when(F.size(of) > 0, F.filter(F.sequence(F.lit(0), F.size(of) - 1), begins)).otherwise(F.array().cast("array<int>"))
        cut = lambda starts: F.flatten(F.transform(starts, lambda a, k: F.aggregate(F.slice(of, a + 1, F.coalesce(F.get(starts, k + 1), F.size(of)) - a), state, step, end)))
        return t.let(F.concat(F.array(F.lit(0)), places), cut)

    return t.let(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: t.squeeze(F.coalesce(x, F.lit("")))), entries)


def only_left(left: Column, right: Column, most: int = 5) -> Column:
    """WN9: up to `most` items of left that a sequence alignment with right deletes or replaces, in order."""

    def of(a, b) -> list[str]:
        blocks = difflib.SequenceMatcher(a=list(a), b=list(b), autojunk=False).get_opcodes()
        return [x for tag, i, j, _, _ in blocks if tag in ("delete", "replace") for x in a[i:j]][:most]

    @F.pandas_udf("array<string>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    none = F.array().cast("array<string>")
    return run(F.coalesce(left, none), F.coalesce(right, none))


def cited_references(texts: DataFrame, references: DataFrame) -> DataFrame:
    """DC11: (paper, n, kind, start, line, raw, author, year, rung, n_refs, first_ref): the citations of texts(paper, text) met with references(paper, ref, surname, year).

    Each author and year is one row, each number of a numeric citation another (its author is empty and its year the number,
    found among the references by their place, `pos`). Rung 1 is the exact year, 2 the year without its letter, 0 none.
    """
    found = texts.select("paper", F.posexplode(ct.citations(F.col("text"))).alias("n", "c"))
    numbers = F.transform(b.expanded_numbers(F.col("c.raw")), lambda x: F.struct(F.lit("").alias("author"), x.cast("string").alias("year")))
    each = found.select("paper", "n", "c.kind", "c.start", "c.line", "c.raw", F.explode(F.when(F.col("c.kind") == "numeric", numbers).otherwise(F.col("c.cited"))).alias("a"))
    rows = each.select("paper", "n", "kind", "start", "line", "raw", "a.*", t.cited_surname(F.col("a.author")).alias("s"), t.base_year(F.col("a.year")).alias("base"))
    named = references.select("paper", F.col("surname").alias("s"), t.base_year(F.col("year")).alias("base"), "ref", F.lower("year").alias("full")).filter("s <> ''")
    placed = references.select("paper", F.lit("").alias("s"), F.col("pos").cast("string").alias("base"), "ref", F.col("pos").cast("string").alias("full"))
    by = ["paper", "s", "base"]
    known = named.unionByName(placed).groupBy(*by).agg(F.collect_set(F.struct("full", "ref")).alias("refs"))  # the references of one paper, author and year
    met = rows.join(known, by, "left")
    exact = F.filter("refs", lambda r: r["full"] == F.lower("year"))
    chosen = F.when(F.size(exact) > 0, exact).otherwise(F.col("refs"))
    rung = F.when(F.col("refs").isNull(), 0).when(F.size(exact) > 0, 1).otherwise(2)
    return met.select("paper", "n", "kind", "start", "line", "raw", "author", "year", rung.alias("rung"), F.when(rung > 0, F.size(chosen)).otherwise(0).alias("n_refs"), F.array_min(F.transform(chosen, lambda r: r["ref"])).alias("first_ref"))


def wire_events(lines: DataFrame) -> DataFrame:
    """SC14: (type, time, tool_call_id, name, args, parent, output_chars, output_preview) beside the columns of lines(value): calls and results of tools.

    Events may be wrapped in one of type context.append_loop_event; lines that are no JSON and other events are left out.
    """
    root = F.try_parse_json("value")
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    opened = lines.withColumn("__root", root).withColumn("__event", F.when(get(F.col("__root"), "$.type") == "context.append_loop_event", get(F.col("__root"), "$.event", "variant")).otherwise(F.col("__root")))
    e = F.col("__event")
    some = lambda path: F.nullif(get(e, path), F.lit(""))
    result = get(e, "$.result", "variant")
    output = F.coalesce(F.when(F.schema_of_variant(result).startswith("OBJECT"), F.coalesce(some("$.result.output"), some("$.result.stdout"), some("$.result.stderr"))).otherwise(get(e, "$.result")), F.lit(""))
    kind = get(e, "$.type")
    call, answer = kind == "tool.call", kind == "tool.result"
    kept = [F.col(c) for c in lines.columns if c != "value"]
    return opened.filter(call | answer).select(
        *kept,
        kind.alias("type"),
        F.coalesce(get(F.col("__root"), "$.time"), get(e, "$.time")).alias("time"),
        get(e, "$.toolCallId").alias("tool_call_id"),
        F.when(call, get(e, "$.name")).alias("name"),
        F.when(call, F.to_json(get(e, "$.args", "variant"))).alias("args"),
        F.when(answer, get(e, "$.parentUuid")).alias("parent"),
        F.when(answer, F.char_length(output)).alias("output_chars"),
        F.when(answer, F.substring(output, 1, PREVIEW)).alias("output_preview"),
    )


def verification_checks(stated: DataFrame, resources: DataFrame) -> DataFrame:
    """DC13: (paper, origin, resource_id, name, method, status, url, notes): stated checks and one of each resource.

    The method is who checked the repository, else who checked availability, else agent; an absent status is unknown.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    own = resources.select("paper", F.lit("resource").alias("origin"), "resource_id", "name", F.coalesce(some("repository_checked_by"), some("checked_by"), F.lit("agent")).alias("method"), F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("notes", F.lit("")).alias("notes"))
    return stated.select("paper", F.lit("stated").alias("origin"), "resource_id", "name", "method", "status", "url", "notes").unionByName(own)


def run_report(resources: DataFrame, checker: str = "github_mcp") -> DataFrame:
    """DC13: (paper, resource_count, github_checked_count)."""
    return resources.groupBy("paper").agg(F.count(F.lit(1)).alias("resource_count"), F.count_if(F.coalesce(F.col("repository_checked_by") == checker, F.lit(False))).alias("github_checked_count"))


def find_statements(queries: DataFrame, statements: DataFrame, near: DataFrame, edges: DataFrame, n: int = retrieval.TOP_N) -> DataFrame:
    """RT7: (q, id, place, evidence, kind, text, reusable, papers) for queries(q, text, kind): statements(id, kind, text) by text and by vector.

    near(q, id, score) is the vector channel, read further than the pool, as a query may want one kind only (null: any).
    Claims belong to their papers and are not reusable.
    """
    asked = queries.select("q", "text", F.col("kind").alias("wanted"))
    kinds = statements.select("id", F.col("kind").alias("k"))
    of_kind = near.join(asked.select("q", "wanted"), "q").join(kinds, "id").filter("wanted is null or wanted = k").select("q", "id", "score")
    channels = [("lexical_text", retrieval.bm25_top(asked, statements, retrieval.POOL)), ("semantic", retrieval.top(of_kind, retrieval.POOL))]
    kept = [c.withColumn("channel", F.lit(name)) for name, c in channels]
    best = retrieval.fuse(kept[0].unionByName(kept[1]), n=n)
    papers = graph.statements(best.select("id"), edges).select("id", "papers")
    return best.join(statements.select("id", "kind", "text"), "id").join(papers, "id").select("q", "id", "place", "evidence", "kind", "text", (F.col("kind") != "Claim").alias("reusable"), "papers")


Patch = tuple[str, Callable[[DataFrame], bool], Callable[[DataFrame], DataFrame]]


def supplemented(df: DataFrame, patches: list[Patch], mode: str = "auto") -> tuple[DataFrame, list[dict]]:
    """DC15: df after the patches (name, applies, apply) in order, and a report of each.

    A patch that fails is reported and skipped in mode auto and raises in mode required; mode off applies none.
    """
    report = []
    for name, applies, apply in patches if mode != "off" else ():
        item = {"patch": name, "applied": False, "skipped": False, "error": ""}
        report.append(item)
        try:
            if applies(df):
                df = apply(df)
                item["applied"] = True
            else:
                item["skipped"] = True
        except Exception as error:
            item["error"] = str(error)
            if mode == "required":
                raise
    return df, report
