"""Parameters of the operators, with the defaults of the application that they serve."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class Params:
    """now: the end of all windows; operators never read the clock."""

    now: datetime = datetime(2024, 1, 31)
    # trends
    window_hours: float = 168.0
    weight_level: float = 0.5
    weight_velocity: float = 0.35
    weight_jerk: float = 0.15
    # phase space and events
    temperature_threshold: float = 0.5
    frequency_threshold: float = 0.5
    sigma: float = 2.0
    inactive_ceiling: float = 0.3
    surprise_threshold: float = 3.0
    convergence_threshold: float = 0.7
    reinforcement: float = 0.15
    reinforcement_cap: float = 3.0
    # lattice
    lattice_primes: int = 150
    lattice_min_shared: int = 30
    glyph_primes: int = 60
    glyph_min_shared: int = 6
    max_radius: float = 0.95
    # tensor
    weight_cooccurrence: float = 0.5
    weight_synchronicity: float = 0.3
    weight_semantic: float = 0.2
    weight_semiotic: float = 0.15
    weight_glyph: float = 0.2
    weight_meta: float = 0.4
    weight_inhibition: float = 0.2
    retention: float = 0.1
    bridge_bonus: float = 1.0
    min_tensor: float = 0.3
    min_semiotic: float = 0.05
    min_edge: float = 0.3
    weight_directed: float = 0.3
    # learning rates
    alpha_centroid: float = 0.1
    alpha_edge: float = 0.15
    # retrieval
    similarity_threshold: float = 0.3
    min_score_tagged: float = 0.5
    min_score_untagged: float = 0.25
    weight_similarity: float = 0.7
    weight_tags: float = 0.3
    hub_degree: int = 25
    fan_depth: int = 1
    min_inward: float = 0.01
    lexical_length: int = 3
    centroid_threshold: float = 0.4
    context_threshold: float = 0.2
    context_memories: int = 5
    # documents
    criticality: float = 0.3
