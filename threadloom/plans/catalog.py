"""Imports every module that registers queries."""

from threadloom.plans import chaining, edges, graphs, ingest, models, profiles, readers, reports, scoring, shaping, streams  # noqa: F401
from threadloom.plans.registry import ORACLES, QUERIES  # noqa: F401
