"""Parameters of the spatio-temporal operators."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, sqrt

#: Planar kilometres of one degree.
KM_PER_DEGREE = 87.944
ZONE = "Australia/Melbourne"


@dataclass(frozen=True)
class Density:
    """Density clustering: a core point has more than `min_points` others closer than `epsilon`.

    Distance is Euclidean over degrees of longitude and latitude and time, a
    millisecond being `km_per_ms` kilometres.
    """

    min_points: int = 3
    km: float = 0.2
    ms: int = 1_200_000
    km_per_ms: float = 0.1 / 600_000
    km_per_degree: float = KM_PER_DEGREE

    @property
    def epsilon(self) -> float:
        """In degrees."""
        return sqrt(self.km**2 + (self.ms * self.km_per_ms) ** 2) / self.km_per_degree

    @property
    def horizon_ms(self) -> int:
        """How far apart in time points of one chain of `min_points` neighbours may be."""
        return floor(self.epsilon * self.km_per_degree / self.km_per_ms + 1 + 0.5) * (self.min_points - 1)

    @property
    def depth_per_ms(self) -> float:
        return self.km_per_ms / self.km_per_degree


def flat_epsilon(km: float, ms: int, km_per_degree: float = KM_PER_DEGREE) -> float:
    """Radius when time, if it counts at all, weighs as much as space."""
    side = km / km_per_degree
    return sqrt(side**2 + (side if ms else 0.0) ** 2)


def flat_speed(km: float, ms: int, km_per_degree: float = KM_PER_DEGREE) -> float:
    """Degrees a millisecond of flat_epsilon()."""
    return km / km_per_degree / ms
