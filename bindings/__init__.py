"""Queries over the driver's tables, one per operator, each with its SQL twin where one exists."""

from bindings import jobs, models, profiles, scalars, sequences, sources, streams, tables  # noqa: F401
from bindings.base import REGISTRY

__all__ = ["REGISTRY"]
