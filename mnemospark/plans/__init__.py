"""All queries: importing this package registers them."""

from . import claims, derived, distil, extension, ingest, report, retrieval, runtime, streaming, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
