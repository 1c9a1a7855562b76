"""All registered queries and their SQL checks."""

from __future__ import annotations

from lexspan.plans import base, comparisons, lectures_queries, manifests, retrieval_queries, texts  # noqa: F401  (modules register on import)

QUERIES, ORACLES = base.QUERIES, base.ORACLES
