"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

from quillmesh.session import table

#: query name -> (module, function, tables)
_QUERIES = {
    "op1_decontaminate": ("decontaminate", "decontamination_digest", ("documents", "benchmark")),
    "op2_line_dedup": ("line_dedup", "line_dedup_digest", ("documents",)),
    "op3_quality_gam": ("quality_gam", "quality_scores", ("documents", "labels")),
    "op4_substring_dedup": ("substring_dedup", "substring_dedup_digest", ("documents",)),
    "op5_quality_rules": ("quality_rules", "quality_rules_digest", ("documents",)),
    "op6_language_id": ("language_id", "language_digest", ("documents",)),
    "op7_simhash_dedup": ("simhash", "simhash_digest", ("documents",)),
    "op8_toxicity": ("toxicity", "toxicity_scores", ("documents", "labels")),
    "op9_mix_sources": ("mixing", "mix_digest", ("documents",)),
    "op10_license_scan": ("licenses", "license_digest", ("documents",)),
    "op11_sharding": ("sharding", "shard_digest", ("documents",)),
    "op12_vector_codes": ("vector_codes", "vector_codes_digest", ("embeddings",)),
    "op13_spelling": ("spelling", "spelling_digest", ("documents",)),
}

#: query name -> (module, function that gives the SQL)
_SQL = {
    "op11_sharding": ("sharding", "shard_sql"),
    "op12_vector_codes": ("vector_codes", "vector_codes_sql"),
    "op13_spelling": ("spelling", "spelling_sql"),
}


def _named(module: str, function: str):
    return getattr(import_module(f"quillmesh.llm.{module}"), function)


def _query(module: str, function: str, tables: tuple[str, ...]):
    def run(spark, sf_dir):
        return _named(module, function)(*[table(spark, sf_dir, t) for t in tables])

    return run


def queries() -> dict:
    return {name: _query(*spec) for name, spec in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _named(*spec)() for name, spec in _SQL.items()}
