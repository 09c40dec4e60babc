"""Every registered query of the library proper; importing it registers them."""

from __future__ import annotations

from caselode.plans import admissions, attention, candidates, cases, catalogue, encoding, evaluation, exports, generation, graphs, nested, ranking, records, recurrent, reports, retrieval, samples, scoring, serving, set_losses, sets, streams, texts  # noqa: F401
from caselode.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
