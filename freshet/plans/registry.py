"""All registered queries of the flood-risk operators, with their SQL.

A query module exposes ``QUERIES`` (name -> callable) and ``ORACLES`` (name -> SQL).
"""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = (
    "freshet.plans.q_clean",
    "freshet.plans.q_agg",
    "freshet.plans.q_series",
    "freshet.plans.q_spatial",
    "freshet.plans.q_grid",
    "freshet.plans.q_rel",
    "freshet.plans.q_metrics",
    "freshet.plans.q_tables",
    "freshet.plans.q_models",
    "freshet.plans.q_jobs",
)

FLAGSHIP = "G13_first_crossing"


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(name), attribute).items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = value
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
