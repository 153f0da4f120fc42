"""Named operators: the library's extension point. An operator takes (spark, inputs, params) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Operator = Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]
_known: dict[str, Operator] = {}


def operator(name: str) -> Callable[[Operator], Operator]:
    """Decorator: registers under a name that is still free."""

    def keep(f: Operator) -> Operator:
        if name in _known:
            raise ValueError(f"operator {name!r} is there already")
        _known[name] = f
        return f

    return keep


def build(name: str) -> Operator:
    if name not in _known:
        raise KeyError(f"unknown operator {name!r}; known: {', '.join(sorted(_known))}")
    return _known[name]


def run(name: str, spark: SparkSession, inputs: dict[str, DataFrame], **params) -> DataFrame:
    return build(name)(spark, inputs, params)


def names() -> list[str]:
    return sorted(_known)
