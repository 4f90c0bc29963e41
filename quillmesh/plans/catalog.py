"""The catalogue of registered queries: name -> (function, SQL or None)."""

from __future__ import annotations

from importlib import import_module


MODULES = ("graph_queries", "text_queries", "retrieval_queries", "bibliography_queries", "report_queries", "commit_queries", "merge_queries", "anchor_queries", "candidate_queries", "paper_queries", "package_queries", "page_queries", "search_queries", "format_queries", "validation_queries", "figure_queries", "sink_queries", "role_queries")


def modules() -> list:
    return [import_module(f"quillmesh.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {name: f for m in modules() for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in modules() for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark, sf_dir):
    return queries()["ac1_resolve"](spark, sf_dir)
