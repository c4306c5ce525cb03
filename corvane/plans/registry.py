"""ID -> query and ID -> SQL of the reference's own operators."""

from __future__ import annotations

from . import audit, budget, chunks, clinical, deid, evaluation, governance, ingest, metrics, quality, search, streams, versions  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
