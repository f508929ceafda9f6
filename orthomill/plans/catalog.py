"""All registered queries; importing this module fills the registry."""

from orthomill.plans import (  # noqa: F401
    queries_fusion, queries_geometry, queries_io, queries_metrics, queries_streaming, queries_tiling)
from orthomill.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
