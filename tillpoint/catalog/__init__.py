"""Registry of runnable queries: name -> (spark callable, DuckDB oracle SQL or None).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame computed
from the driver tables in ``sf_dir``.
"""
from __future__ import annotations

import importlib

MODULES = ["margin_q", "deals_q", "dashboard_q", "brands_q", "retention_q", "basket_q", "heatmap_q", "waterfall_q", "staff_q", "reports_q", "advice_q", "cube_q", "period_q", "ingest_q", "rows_q"]


def registry() -> dict:
    out: dict = {}
    for m in MODULES:
        mod = importlib.import_module(f"tillpoint.catalog.{m}")
        for k, v in mod.ENTRIES.items():
            if k in out:
                raise ValueError(f"duplicate query name {k}")
            out[k] = v
    return out
