"""Registered queries: a Spark callable and, where SQL can say it, its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load_all():
    from workload import aggregates, detection, findings, packages, scans, streams  # noqa: F401

    return QUERIES, ORACLES
