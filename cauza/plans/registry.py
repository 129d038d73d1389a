"""All queries of the library, and the SQL that they are held against."""

from __future__ import annotations

from . import binning, discrete, effects, ensembles, graphs, inputs, learning, models, networks, trees

MODULES = [discrete, graphs, trees, binning, ensembles, effects, learning, networks, inputs, models]


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
