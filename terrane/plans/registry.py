"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
