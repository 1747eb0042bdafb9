"""Queries over the given tables, each next to the SQL that must agree with it."""

from __future__ import annotations

from .registry import ORACLES, QUERIES  # noqa: F401
from . import codes, corpus, encode, merges, metrics, runs, streams, tasks, vocab  # noqa: F401,E402
