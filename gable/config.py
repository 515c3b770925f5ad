"""Parameters of the engine. Every operator takes them as arguments; nothing reads a clock or the environment."""

from __future__ import annotations

from dataclasses import dataclass, field

# Bounds, weights and thresholds of the listing business.


@dataclass(frozen=True)
class Bounds:
    price: tuple[int, int] = (10_000, 500_000)
    surface: tuple[float, float] = (10.0, 300.0)
    rooms: tuple[int, int] = (1, 10)
    rent: tuple[float, float] = (200.0, 3000.0)
    energy: tuple[str, ...] = ("A", "B", "C", "D", "E", "F", "G")
    city_names: tuple[str, ...] = ("besançon", "besancon")
    zip_pattern: str = r"\b25[0-9]{3}\b"
    min_surface_by_rooms: dict[int, float] = field(default_factory=lambda: {1: 9.0, 2: 20.0, 3: 35.0, 4: 50.0, 5: 65.0})
    agency_words: tuple[str, ...] = (
        "agence", "cabinet", "groupe immobilier", "mandataire", "réseau", "reseau", "frais d'agence", "frais d agence", "honoraires",
        "exclusivité", "exclusivite", "mandat", "réf.", "ref.", "référence", "reference", "n° mandat",
    )
    agency_hits: int = 2


@dataclass(frozen=True)
class DedupConfig:
    price_pct: float = 5.0
    surface_m2: float = 2.0
    similarity: float = 0.7
    max_completeness: float = 0.8
    tracking: tuple[str, ...] = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "ref", "tracking")


@dataclass(frozen=True)
class ObservatoryConfig:
    half_life_days: float = 30.0
    unknown_weight: float = 0.5
    min_rows: int = 5
    iqr_factor: float = 1.5
    typical_surface: dict[str, float] = field(default_factory=lambda: {"T1": 25.0, "T2": 45.0, "T3": 65.0, "T4": 85.0, "T5": 105.0})
    dead_zone: float = 0.20
    cap: float = 0.15


@dataclass(frozen=True)
class ScoreConfig:
    weights: dict[str, float] = field(default_factory=lambda: {"yield": 0.40, "location": 0.25, "energy": 0.15, "negotiation": 0.10, "vacancy": 0.10})
    yield_range: tuple[float, float] = (4.0, 12.0)
    energy: dict[str, float] = field(default_factory=lambda: {"A": 100.0, "B": 85.0, "C": 65.0, "D": 40.0, "E": 0.0, "F": 0.0, "G": 0.0})
    energy_unknown: float = 30.0
    signals: tuple[str, ...] = ("urgent", "prix a debattre", "a negocier", "faire offre", "vente rapide", "mutation", "succession", "divorce", "baisse de prix")
    signal_points: float = 15.0
    max_signals: int = 2
    drop_points: float = 40.0
    tension: tuple[float, float] = (0.8, 0.5)
    vacancy: tuple[float, float, float] = (90.0, 60.0, 30.0)
    top: tuple[float, float] = (80.0, 8.0)
    good: tuple[float, float] = (60.0, 8.0)


@dataclass(frozen=True)
class GeoConfig:
    weights: dict[str, float] = field(default_factory=lambda: {"tram": 0.30, "shops": 0.25, "campus": 0.20, "station": 0.15, "appeal": 0.10})
    radius: dict[str, float] = field(default_factory=lambda: {"tram": 500.0, "shops": 300.0, "campus": 1000.0, "station": 1500.0})
    district_radius: float = 2000.0
    earth: float = 6_371_000.0


@dataclass(frozen=True)
class HealthConfig:
    failures: int = 3
    parse_rate: tuple[float, float] = (0.50, 0.65)
    disk: tuple[float, float] = (0.20, 0.30)
    budget: float = 0.80
    fresh_hours: int = 24


@dataclass(frozen=True)
class RetentionConfig:
    archived_days: int = 180
    rents_days: int = 360
    log_days: int = 90
    rejects_days: int = 30
    registry_days: int = 60
