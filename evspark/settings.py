"""Names that a deployment chooses: label keys, headers, finalizer, defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    label_prefix: str = "events.local"
    uuid_header: str = "Event-Uuid"
    finalizer: str = "sensor-controller"
    idle_default_s: int = 60
    idle_disabled_s: int = 10 * 365 * 86400
    idle_longest_s: int = 100 * 365 * 86400
    endpoint_timeout_s: int = 300
    roster_step_s: int = 10

    def label(self, name: str) -> str:
        return f"{self.label_prefix}/{name}"

    @property
    def idle_enable_label(self) -> str:
        return self.label("scale-to-zero-enable")

    @property
    def idle_time_label(self) -> str:
        return self.label("scale-to-zero-idle-time")


DEFAULTS = Settings()
