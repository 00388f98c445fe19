"""All queries of this subpackage."""

from __future__ import annotations

from stepwise.llm import q_audit, q_dups, q_native, q_text

QUERIES = {**q_text.QUERIES, **q_native.QUERIES, **q_dups.QUERIES, **q_audit.QUERIES}
ORACLES = {**q_native.ORACLES, **q_audit.ORACLES}
