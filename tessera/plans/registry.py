"""Queries by operator, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans.fixtures import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "pix03_region_plan"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under a name, and its check."""

    def add(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = oracle(sql)
        return function

    return add


from tessera.plans import annotations, catalog, codecs, files, geometry, headers, layout, metadata, more, pixels, records, samples, shapes, specimens, web  # noqa: E402, F401
