"""Registered queries: every operator over the given tables, with the SQL it must agree with."""

from . import columns, pages, search, sources, streams, tables  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
