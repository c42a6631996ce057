"""Registered queries and their checking SQL."""

from . import layouts, pipelines, scalars, selections  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
