"""Registered queries, by theme."""

from . import aggregates, columns, features, feeds, inference, joins, ledger, scores, selection, stores, streams, text, value  # noqa: F401
