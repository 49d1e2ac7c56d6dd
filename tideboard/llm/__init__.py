"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

``QUERIES`` has one ``opN_<name>`` for each operator; ``TWINS`` has the SQL of those that SQL can express.
"""

from importlib import import_module

_PARTS = ("planes", "urls", "simhash", "fm", "mtree", "pieces", "slots", "chroma", "raking", "kneser", "trie", "vertical", "bond")


def queries():
    return {k: q for part in _PARTS for k, q in import_module(f"tideboard.llm.{part}").QUERIES.items()}


def twins():
    return {k: q for part in _PARTS for k, q in getattr(import_module(f"tideboard.llm.{part}"), "TWINS", {}).items()}
