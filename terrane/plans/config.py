"""Settings of each stage."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Associates:
    radius: float = 50.0
    least_pairs: int = 15
    most_sites: int = 400
    bands: int = 10
    seed: int = 42
    west: float = 10.0
    east: float = 25.0
    south: float = 55.0
    north: float = 69.5
    focal_ids: tuple[str, ...] = ()
    focal_names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Features:
    cell_size: float = 10_000.0
    neighbours: int = 15
    include_self: bool = True


@dataclass(frozen=True)
class Clusters:
    kernel: str = "adaptive"
    beta: float = 1.0
    two_hop: float = 0.02
    symmetry: str = "max"
    resolutions: tuple[float, ...] = (0.3004, 0.33095, 0.36461)
    target: int = 4
    least_size: int = 25
    seed: int = 123


@dataclass(frozen=True)
class Markers:
    q_most: float = 0.05
    top: int = 40
    min_delta: float = 1e-5
    min_prevalence: float = 0.05


@dataclass(frozen=True)
class Evaluation:
    permutations: int = 999
    most_pairs: int = 50_000
    seed: int = 12345
