"""DuckDB statements that recompute each registered query from the source tables."""

from __future__ import annotations


def all_statements() -> dict[str, str]:
    from . import cleaning, corpus, dashboard, derived, learning, models

    out: dict[str, str] = {}
    for module in (corpus, derived, cleaning, dashboard, learning, models):
        for key, text in module.statements().items():
            if key in out:
                raise ValueError(f"duplicate check statement {key}")
            out[key] = text
    return out
