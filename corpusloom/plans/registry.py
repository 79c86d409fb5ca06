"""All queries of the engine with their oracles."""

from corpusloom.plans import answering, ingestion, operating, retrieval, syncing, tenants, textual  # noqa: F401
from corpusloom.plans.base import ORACLE, QUERIES  # noqa: F401
