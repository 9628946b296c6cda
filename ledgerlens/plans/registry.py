"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus DuckDB oracle SQL."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from ..session import prepare

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_MODULES = [
    "ledger_queries",
    "agg_queries",
    "sequence_queries",
    "bank_queries",
    "contract_queries",
    "strategy_queries",
    "join_queries",
    "stream_queries",
    "model_queries",
    "synth_queries",
    "text_queries",
    "source_queries",
    "sequence2_queries",
    "density_queries",
    "corr_queries",
    "store_queries",
]


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            prepare(spark)          # UTC session zone, AQE, checkpoint folder, package on workers
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"ledgerlens.plans.{m}")
