"""Where the queries of the plan modules are collected."""

from __future__ import annotations

from collections.abc import Callable

from .fixtures import oracle as expand

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under its inventory name, with the SQL that must give the same rows, if SQL can."""

    def add(function: Callable) -> Callable:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = expand(oracle)
        return function

    return add
