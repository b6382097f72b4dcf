"""DataFrame operators: retrieval, fusion, ranking, lookups, sessions, upkeep."""
