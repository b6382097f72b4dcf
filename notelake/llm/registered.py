"""All queries of the package, by name."""

from notelake.llm import query_fingerprint, query_join, query_language, query_mixing, query_packing, query_pii, query_repair, query_rules, query_runs, query_simhash, query_sites, query_substring, query_toxicity  # noqa: F401
from notelake.llm.queries import REGISTRY

__all__ = ["REGISTRY"]
