"""Frames that a plan reads several times: cached while the plan runs, given back before the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame

_HELD: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """``df`` cached until ``release``. A frame made from it stays right afterwards, it is only computed anew."""
    _HELD.append(df.persist())
    return df


def release() -> None:
    while _HELD:
        _HELD.pop().unpersist()
