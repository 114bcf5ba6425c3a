"""Every registered query of the engine with its oracle, gathered from the plan modules."""

from __future__ import annotations


def modules() -> list:
    from .plans import analysis_queries, encoding_queries, io_queries, link_queries, more_queries, span_queries

    return [span_queries, link_queries, analysis_queries, encoding_queries, io_queries, more_queries]


def queries() -> dict:
    return {name: run for m in modules() for name, run in m.QUERIES.items()}


def _long_counts(sql: str) -> str:
    """DuckDB's count_if is a 128-bit number, Spark's a long: casts each that isn't cast yet."""
    out, at = [], 0
    while (found := sql.find("count_if(", at)) >= 0:
        end, depth = found + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(sql[at:end] + ("" if sql.startswith("::", end) else "::BIGINT"))
        at = end
    return "".join(out) + sql[at:]


def oracle_sql() -> dict:
    return {name: _long_counts(sql) for m in modules() for name, sql in m.ORACLES.items()}


def flagship(spark, sf_dir):
    from .plans.span_queries import character_scores

    return character_scores(spark, sf_dir)
