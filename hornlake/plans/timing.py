"""The timing interface, kept for callers: Catalyst and adaptive execution keep their own statistics."""

from __future__ import annotations

from contextlib import AbstractContextManager, nullcontext
from typing import Any


def reset_optimizer_cache() -> None:
    """Nothing is cached between queries."""


def record_fact_timing(*_: Any, **__: Any) -> None:
    """Timings are not learned from."""


def get_optimizer_timing_stats() -> dict:
    return {}


def time_fact_execution(*_: Any, **__: Any) -> AbstractContextManager:
    return nullcontext()
