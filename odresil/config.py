"""Constants of the mobility engine; a ``Windows`` value describes a unit's calendar."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Windows:
    """Days of a unit's trailing window and the slots of a day that count."""

    normal: int = 13
    buffer: int = 5
    disaster: int = 12
    slots: int = 12
    first_slot: int = 3
    last_slot: int = 10
    first_weekday: int = 0  # Monday

    @property
    def days(self) -> int:
        return self.normal + self.buffer + self.disaster

    @property
    def disaster_start(self) -> int:
        return self.normal + self.buffer


#: The driver's event table has 30 days from Monday 2024-01-01.
EVENTS = Windows()
CATEGORIES = ("residential", "commercial", "leisure", "industrial", "health", "public")
DOMINANT, IWF_POWER, EPSILON = 0.4, 2.0, 1e-9
#: Bands of the day and their hours (fixed values).
BANDS = {"morning_peak": (6, 10), "midday": (10, 16), "evening_peak": (16, 20), "night": (20, 22)}
EARTH_KM, NM_KM = 6371.0088, 1.852
