"""Tiny text helpers for writing the DuckDB oracle SQL."""
from __future__ import annotations


def MS(x: str) -> str:
    """Money sum, 0 for no rows, to the cent."""
    return f"round(coalesce(sum({x}), 0), 2)"


def MSI(cond: str, x: str) -> str:
    return f"round(coalesce(sum(CASE WHEN {cond} THEN {x} END), 0), 2)"


def IS(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT)"


def ISI(cond: str, x: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {cond} THEN {x} END), 0) AS BIGINT)"


def CNT(cond: str) -> str:
    return f"CAST(count(CASE WHEN {cond} THEN 1 END) AS BIGINT)"


def SD(a: str, b: str, default: str = "0.0") -> str:
    """a / b, default when b is 0 or null."""
    return f"(CASE WHEN ({b}) = 0 OR ({b}) IS NULL THEN {default} ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def SDN(a: str, b: str) -> str:
    return SD(a, b, "CAST(NULL AS DOUBLE)")


def R(x: str, n: int = 1) -> str:
    k = f"{10 ** n}.0"
    return f"(CAST(floor(CAST({x} AS DOUBLE) * {k} + 0.5) AS DOUBLE) / {k})"


def PCTCHG(cur: str, prev: str) -> str:
    return (f"(CASE WHEN ({prev}) = 0 OR ({prev}) IS NULL THEN CAST(NULL AS DOUBLE) "
            f"ELSE (CAST({cur} AS DOUBLE) - ({prev})) / abs({prev}) * 100 END)")
