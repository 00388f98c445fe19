"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from stepwise.plans import q_answers, q_chains, q_evaluate, q_preference, q_search, q_sources, q_streaming, q_tokens, q_votes  # noqa: F401
from stepwise.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
