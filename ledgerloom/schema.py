"""Closed value universes and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

# The closed universes that results are counted over.
STATES = ("FLAT", "ONE_BUY", "ONE_SELL", "HEDGED_1X1", "UNBALANCED_HEDGE", "MULTI_POSITION")
OBSERVED_STATES = (*STATES, "CENSORED")
ENDPOINTS = {
    "HEDGED_1X1": ("unlock_occurrence", ("UNLOCK_TO_BUY", "UNLOCK_TO_SELL")),
    "ONE_BUY": ("rehedge_sell_occurrence", ("REHEDGE_SELL",)),
    "ONE_SELL": ("rehedge_buy_occurrence", ("REHEDGE_BUY",)),
}


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def allow_only(df: DataFrame, allowed: Iterable[str], forbidden: Iterable[str] = ()) -> DataFrame:
    """The allowed columns; an error if one is missing or forbidden, so that no target leaks into a model's inputs."""
    allowed = list(allowed)
    leaks = sorted(set(allowed) & set(forbidden))
    if leaks:
        raise ValueError(f"forbidden columns: {', '.join(leaks)}")
    return require_columns(df, allowed).select(*allowed)
