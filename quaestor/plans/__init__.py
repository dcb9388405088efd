"""The registered queries for the reference's own operators."""

from . import analysis, checks, daily, listing, matching, nested, picks, queues, reports, rollups, scalars, searches, texts  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
