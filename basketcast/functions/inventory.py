"""Scalar inventory helpers evaluated once on the driver and passed as literals."""

from __future__ import annotations

# Z-scores per service level, and the fallback for any other level.
SERVICE_FACTORS = {0.90: 1.282, 0.95: 1.645, 0.98: 2.054, 0.99: 2.326}
DEFAULT_SERVICE_FACTOR = 1.645


def service_factor(service_level: float) -> float:
    """Normal z-score for the service level; unknown levels fall back to 95 %."""
    return SERVICE_FACTORS.get(round(float(service_level), 4), DEFAULT_SERVICE_FACTOR)
