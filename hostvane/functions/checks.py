"""Argument checks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from hostvane.schemas import AGGREGATIONS, DIMENSIONS, FEATURES


def one_of(value: str, allowed: Iterable[str], what: str) -> str:
    allowed = tuple(allowed)
    if value not in allowed:
        raise ValueError(f"invalid {what}: {value!r}; expected one of {', '.join(allowed)}")
    return value


def metric(name: str) -> str:
    return one_of(name, FEATURES, "metric")


def dimension(name: str) -> str:
    return one_of(name, DIMENSIONS, "dimension")


def aggregation(name: str) -> str:
    return one_of(name, AGGREGATIONS, "aggregation")


def metrics(names: Sequence[str]) -> tuple[str, ...]:
    if not names:
        raise ValueError("at least one metric is required")
    return tuple(metric(n) for n in names)


def at_least(value: int, low: int, what: str) -> int:
    if value < low:
        raise ValueError(f"{what} must be at least {low}, got {value}")
    return value


def at_most(value: int, high: int, what: str) -> int:
    if value > high:
        raise ValueError(f"{what} must be at most {high}, got {value}")
    return value
