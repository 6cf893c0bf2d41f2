"""All registered queries outside the training-data package."""

from __future__ import annotations

from . import accounts, base, causal, engines, features, front, market, moments, records, research, resampling, robust, search, stats, trading, verify  # noqa: F401

QUERIES = base.QUERIES
SQL = base.SQL
