"""Registered queries with their SQL twins. Both read the rule lists; the logic is written twice."""

from importlib import import_module

_PARTS = ("extraction", "scans", "relations", "flows")


def _collect(name):
    out = {}
    for part in _PARTS:
        out.update(getattr(import_module(f"tideboard.catalog.{part}"), name))
    return out


def queries():
    return _collect("QUERIES")


def twins():
    return _collect("TWINS")
