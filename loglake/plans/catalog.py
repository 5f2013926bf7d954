"""All registered queries of the log engine, with the SQL that states the same result."""

from __future__ import annotations

from loglake.plans import files, logs, proposals, records, service, unknown
from loglake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "files", "logs", "proposals", "records", "service", "unknown"]
