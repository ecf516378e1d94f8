"""Settings with their defaults and the ranges they must lie in."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Fixed values: (least, most) of the settings that are checked.
RANGES = {
    "batch_size": (1, 1_048_576),
    "heartbeat_interval_ms": (100, 60_000),
    "missed_heartbeats": (1, 10),
    "heartbeat_timeout_ms": (100, 30_000),
}


class _Checked:
    def __post_init__(self):
        for f in fields(self):
            if f.name in RANGES:
                low, high = RANGES[f.name]
                if not low <= getattr(self, f.name) <= high:
                    raise ValueError(f"{f.name} must be between {low} and {high}, not {getattr(self, f.name)}")

    @classmethod
    def of(cls, options: dict[str, str]):
        """From texts, as they come from spark.conf or an options dictionary; unknown names are errors."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in options.items()})


@dataclass(frozen=True)
class ProducerSettings(_Checked):
    batch_size: int = 16_384
    linger_ms: int = 100
    codec: str = "none"
    buffer_memory: int = 33_554_432
    max_block_ms: int = 60_000
    retries: int = 3
    delivery_timeout_ms: int = 120_000
    max_in_flight: int = 5
    max_request_size: int = 1_048_576


@dataclass(frozen=True)
class BrokerSettings(_Checked):
    heartbeat_interval_ms: int = 3_000
    missed_heartbeats: int = 3
    heartbeat_timeout_ms: int = 5_000
    retry_backoff_ms: int = 1_000
    max_retries: int = 3
    segment_bytes: int = 1_048_576
    flush_bytes: int = 524_288
