"""notelake: hybrid search and upkeep of large note collections on Spark."""

from notelake.params import ChunkParams, SearchParams

__all__ = ["ChunkParams", "SearchParams"]
