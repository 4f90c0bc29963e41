"""Queries of the stored text index and of constraint-first search over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import retrieval as r
from quillmesh.operators import search as se
from quillmesh.operators.text_index import STOP_WORDS, TextIndex
from quillmesh.operators.vector_index import VectorIndex
from quillmesh.session import scratch, table

#: The share of cells that a query visits.
PROBE = 0.7

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_VOICED = "'[aeiou]|[^aeiou]y'"


def _cut(w: str, k: int) -> str:
    return f"substr({w}, 1, length({w}) - {k})"


def _after(w: str) -> str:
    return f"CASE WHEN regexp_matches({w}, '(at|bl|iz)$') THEN {w} || 'e' WHEN regexp_matches({w}, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$') THEN {_cut(w, 1)} WHEN regexp_matches({w}, '^[^aeiou]*[aeiouy][^aeiouwxy]$') THEN {w} || 'e' ELSE {w} END"


def _stems(source: str, keys: str) -> str:
    """source(keys, word) with term."""
    one = f"SELECT {keys}, word, CASE WHEN length(word) < 3 THEN word WHEN regexp_matches(word, '(ss|i)es$') THEN {_cut('word', 2)} WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN {_cut('word', 1)} ELSE word END AS a FROM {source}"
    two = f"SELECT {keys}, word, CASE WHEN length(word) < 3 THEN a WHEN a LIKE '%eed' THEN CASE WHEN regexp_matches({_cut('a', 3)}, '[aeiouy][^aeiouy]') THEN {_cut('a', 1)} ELSE a END WHEN a LIKE '%ed' AND regexp_matches({_cut('a', 2)}, {_VOICED}) THEN {_after(_cut('a', 2))} WHEN a LIKE '%ing' AND regexp_matches({_cut('a', 3)}, {_VOICED}) THEN {_after(_cut('a', 3))} ELSE a END AS b FROM ({one})"
    return f"SELECT {keys}, CASE WHEN length(word) >= 3 AND b LIKE '%y' AND regexp_matches({_cut('b', 1)}, {_VOICED}) THEN {_cut('b', 1)} || 'i' ELSE b END AS term FROM ({two})"


def _split(source: str, key: str) -> str:
    return f"(SELECT {key}, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({_STOPS}))) AS word FROM {source})"


def _full(asked: str, texts: str) -> str:
    """CTEs that end in scored(q, id, score): every document with a term is scored."""
    return f"""a_t AS (SELECT DISTINCT q, term FROM ({_stems(_split(asked, 'q'), 'q')})), d_t AS (SELECT id, term, count(*) AS tf FROM ({_stems(_split(texts, 'id'), 'id')}) GROUP BY ALL),
d_l AS (SELECT id, sum(tf) AS len FROM d_t GROUP BY id), d_n AS (SELECT count(*) AS n, avg(len) AS mean FROM d_l), d_f AS (SELECT term, count(*) AS df FROM d_t GROUP BY term),
scored AS (SELECT q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM d_t JOIN d_f USING (term) JOIN a_t USING (term) JOIN d_l USING (id), d_n GROUP BY q, id)"""


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _passages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("q"), "text")


def _index(spark, sf_dir, parts: int = 1) -> TextIndex:
    index = TextIndex(spark, scratch(spark, "text-index"))
    texts = _documents(spark, sf_dir)
    for k in range(parts):
        index.add(texts if parts == 1 else texts.filter(f"id % {parts} = {k}"))
    return index


_TEXTS = "asked AS (SELECT item_id AS q, text FROM benchmark WHERE item_id % 20 = 0), texts AS (SELECT doc_id AS id, text FROM documents)"
_TOP = f"WITH {_TEXTS}, {_full('asked', 'texts')} SELECT q, id, score FROM scored QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 20"


def rt2_indexed(spark, sf_dir):
    return _index(spark, sf_dir).search(_passages(spark, sf_dir), r.POOL)[0]


def rt2_appended(spark, sf_dir):
    """The same over an index of three segments."""
    return _index(spark, sf_dir, 3).search(_passages(spark, sf_dir), r.POOL)[0]


def rt2_terms(spark, sf_dir):
    """The term dictionary."""
    return _index(spark, sf_dir, 2).table("terms").groupBy("term").agg(F.sum("df").alias("df"))


def _content(spark, sf_dir):
    """Documents as nodes of two kinds, with edges to their source and language; sources are parts of ten groups."""
    docs = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    nodes = docs.select("id", F.when(F.col("n_chars") > 600, "Article").otherwise("Note").alias("kind"))
    edge = lambda df, src, kind, dst: df.select(F.col(src).alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
    of_source, of_lang = docs.filter("source is not null"), docs.filter("lang is not null")
    groups = of_source.select("source").distinct()
    return docs, nodes, edge(of_source, "id", "FROM", F.col("source")).unionByName(edge(of_lang, "id", "IN", F.col("lang"))).unionByName(edge(groups, "source", "PART_OF", F.concat(F.lit("group"), F.substring("source", 4, 1))))


LANGS = ("en", "fr", "de", "es")


def ac5(spark, sf_dir):
    """Passages of the benchmark searched among documents of a source group, a language, both, a kind, or all; one in five lists without text."""
    q = F.col("q")
    docs, nodes, edges = _content(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q"), "embedding")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    queries = items.join(vectors, "q", "left").select("q", F.when(q % 5 != 4, F.col("text")).alias("text"), F.when((q % 5 != 4) & (q % 3 != 0), F.col("embedding")).alias("embedding"), F.when(q % 4 == 1, "Article").when(q % 4 == 2, "Note").alias("kind"))
    by_group = items.filter("q % 6 in (0, 1, 2)").select("q", F.lit("FROM").alias("type"), F.concat(F.lit("group"), (q % 10).cast("string")).alias("dst"))
    by_lang = items.filter("q % 6 in (2, 3)").select("q", F.lit("IN").alias("type"), F.element_at(F.array(*[F.lit(x) for x in LANGS]), (q % 4 + 1).cast("int")).alias("dst"))
    index = TextIndex(spark, scratch(spark, "text-index"))
    index.add(docs.select("id", "text"))
    found = se.search(queries, nodes, edges, by_group.unionByName(by_lang), index, vectors.select(F.col("q").cast("string").alias("id"), "embedding"), depth=1)
    return found.select("q", "place", "id", F.round("rrf", 6).alias("rrf"), "evidence", "witnesses", "n_feasible", "candidate_depth", "truncated")


def rt3_indexed(spark, sf_dir):
    """The nearest vectors through the index, of every twentieth vector; approximate, so it has no SQL."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, scratch(spark, "vector-index"))
    index.fit(e)
    index.add(e)
    return index.search(e.filter("id % 20 = 0").withColumnRenamed("id", "q"), e, probe=PROBE).select("q", "id", F.round("score", 4).alias("score"))


_COSINE = "round((1 + list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / 2, 9)"
_AC5 = f"""WITH asked_all AS (SELECT item_id AS q, text, CASE item_id % 4 WHEN 1 THEN 'Article' WHEN 2 THEN 'Note' END AS kind, CASE WHEN item_id % 6 IN (0, 1, 2) THEN 'group' || (item_id % 10) END AS grp, CASE WHEN item_id % 6 IN (2, 3) THEN [{", ".join(f"'{x}'" for x in LANGS)}][item_id % 4 + 1] END AS lng FROM benchmark),
fit AS MATERIALIZED (SELECT q, CAST(doc_id AS VARCHAR) AS id, concat_ws(',', CASE WHEN grp IS NOT NULL THEN 'FROM=' || source END, CASE WHEN lng IS NOT NULL THEN 'IN=' || lang END) AS witnesses FROM asked_all a JOIN documents d
 ON (kind IS NULL OR kind = CASE WHEN n_chars > 600 THEN 'Article' ELSE 'Note' END) AND (grp IS NULL OR 'group' || substr(source, 4, 1) = grp) AND (lng IS NULL OR lang = lng)),
asked AS (SELECT q, text FROM asked_all WHERE q % 5 <> 4), texts AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents), {_full('asked', 'texts')},
vec AS (SELECT a.vec_id AS q, CAST(b.vec_id AS VARCHAR) AS id, {_COSINE} AS score FROM embeddings a JOIN asked_all ON a.vec_id = q, embeddings b WHERE q % 5 <> 4 AND q % 3 <> 0),
chan AS (SELECT q, id, score, 'text' AS channel FROM scored UNION ALL SELECT q, id, score, 'vector' FROM vec UNION ALL SELECT q, id, 0, 'all' FROM fit WHERE q % 5 = 4),
ranked AS (SELECT q, id, channel, row_number() OVER (PARTITION BY q, channel ORDER BY score DESC, id) AS rnk FROM chan SEMI JOIN fit USING (q, id)),
pooled AS (SELECT * FROM ranked WHERE rnk <= CASE channel WHEN 'all' THEN 6 ELSE 20 END),
fused AS (SELECT q, id, round(sum(1.0 / (10 + rnk)), 9) AS rrf, string_agg(channel || ':' || rnk, ',' ORDER BY channel) AS evidence FROM pooled GROUP BY q, id),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rrf DESC, id) AS place, count(*) OVER (PARTITION BY q) > 5 AS truncated FROM fused)
SELECT q, place, id, round(rrf, 6) AS rrf, evidence, witnesses, (SELECT count(*) FROM fit WHERE fit.q = placed.q) AS n_feasible, (SELECT max(c) FROM (SELECT count(*) AS c FROM pooled WHERE pooled.q = placed.q GROUP BY channel)) AS candidate_depth, truncated FROM placed JOIN fit USING (q, id) WHERE place <= 5"""

QUERIES = {
    "rt2_indexed_text": (rt2_indexed, _TOP),
    "rt2_appended_index": (rt2_appended, _TOP),
    "rt2_term_dictionary": (rt2_terms, f"WITH {_TEXTS}, {_full('asked', 'texts')} SELECT term, df FROM d_f"),
    "rt3_indexed_vectors": (rt3_indexed, None),
    "ac5_search": (ac5, _AC5),
}
