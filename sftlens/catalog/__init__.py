from sftlens.catalog import (  # noqa: F401  (registering)
    curation,
    evaluation,
    sessions,
    sources,
    streams,
    telemetry,
    transcripts,
    upkeep,
)
from sftlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
