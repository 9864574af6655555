"""All queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from . import analyses, catalog, exchange, formulas, procedural, programs, streams, views

FLAGSHIP = "F2_taint_findings"


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for name, sql in catalog.SQL.items():
        text = sql if isinstance(sql, str) else sql[0]
        out[name] = lambda spark, sf_dir, text=text: views.run(spark, sf_dir, text)
    return out | procedural.QUERIES | programs.QUERIES | formulas.QUERIES | exchange.QUERIES | streams.QUERIES | analyses.QUERIES


def oracle_sql() -> dict[str, str]:
    out = {name: views.with_views(sql if isinstance(sql, str) else sql[1], 1) for name, sql in catalog.SQL.items()}
    return out | {name: views.with_views(sql, 1) for name, sql in (procedural.ORACLES | programs.ORACLES | formulas.ORACLES | exchange.ORACLES | streams.ORACLES | analyses.ORACLES).items()}
