"""The query catalogue: importing it registers every query."""

from . import documents, graph, ingest, keyword, retrieval, telemetry, thesis, vectors
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "documents", "graph", "ingest", "keyword", "retrieval", "telemetry", "thesis", "vectors"]
