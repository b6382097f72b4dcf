"""Parameters with the engine's defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# The lexical fields in storage order with their default weights.
FIELD_WEIGHTS = {
    "title": 8.0,
    "heading_path": 4.0,
    "body": 1.0,
    "tags": 2.0,
    "properties": 3.0,
}
FIELDS = tuple(FIELD_WEIGHTS)

# Default vault folders and namespace directory parents.
VAULT_FOLDERS = ("code-notes", "rules", "integrations", "sessions", "structure")
NAMESPACE_PARENTS = ("services", "packages", "apps", "libs", "modules")

# The search modes.
MODES = ("hybrid", "bm25_only", "vec_only", "deep")


# The defaults of chunking and search below.
@dataclass(frozen=True)
class ChunkParams:
    """Chunking: sections above ``split_tokens`` (4 chars each) are split by paragraph."""

    split_tokens: int = 1500
    chars_per_token: int = 4

    @property
    def split_chars(self) -> int:
        return self.split_tokens * self.chars_per_token


@dataclass(frozen=True)
class SearchParams:
    """Search defaults; every value can be overridden per call."""

    top_k: int = 10
    candidate_multiplier: int = 5
    lexical_weight: float = 0.7
    vector_weight: float = 0.3
    field_weights: dict[str, float] = field(default_factory=lambda: dict(FIELD_WEIGHTS))
    fusion: str = "rrf"
    rrf_k: int = 60
    metric: str = "l2"
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    idf_floor: float = 1e-6
    strong_min_score: float = 0.85
    strong_min_gap: float = 0.15
    original_weight: float = 2.0
    variant_weight: float = 1.0
    max_variants: int = 2
    rerank_limit: int = 20
    rerank_chars: int = 500
    blend_top: float = 0.75
    blend_mid: float = 0.60
    blend_tail: float = 0.40
    snippet_chars: int = 200

    def __post_init__(self) -> None:
        if abs(self.lexical_weight + self.vector_weight - 1.0) > 1e-9:
            raise ValueError("lexical_weight and vector_weight must add up to 1")
        if self.fusion not in ("rrf", "linear"):
            raise ValueError(f"unknown fusion {self.fusion!r}")
        if self.top_k < 1 or self.candidate_multiplier < 1:
            raise ValueError("top_k and candidate_multiplier must be positive")

    @property
    def candidate_k(self) -> int:
        return self.top_k * self.candidate_multiplier
