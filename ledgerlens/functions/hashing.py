"""Deterministic pseudo-random numbers from keys.

``u(key, tag)`` maps a key to [0, 1) from the first 32 bits of
``md5(key || ':' || tag)``.  DuckDB computes the same number with
``cast('0x' || substr(md5(...), 1, 8) as bigint) / 4294967296.0`` (see
:func:`u_sql`), so synthetic columns agree between the two engines and across
re-runs.  ``rand()`` is never used in a checked query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _key_sql(key) -> str:
    if isinstance(key, str):
        return f"CAST(`{key}` AS STRING)"
    raise TypeError("key must be a column name")


def u_expr(key, tag: str) -> str:
    """Spark SQL text of ``u(key, tag)`` (one parsed expression, no per-node JVM calls)."""
    return (f"(CAST(conv(substring(md5(concat({_key_sql(key)}, ':{tag}')), 1, 8), 16, 10) AS DOUBLE)"
            f" / {TWO_POW_32!r})")


def u(key, tag: str) -> Column:
    return F.expr(u_expr(key, tag))


def _lit(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pick_expr(key, tag: str, values: list[str]) -> str:
    arr = "array(" + ", ".join(_lit(v) for v in values) + ")"
    return f"element_at({arr}, CAST(floor({u_expr(key, tag)} * {len(values)}) AS INT) + 1)"


def pick(key, tag: str, values: list[str]) -> Column:
    """Uniform choice from a fixed list, driven by ``u(key, tag)``."""
    return F.expr(pick_expr(key, tag, values))


def weighted_expr(key, tag: str, values: list[str], weights: list[float]) -> str:
    x = u_expr(key, tag)
    total = float(sum(weights))
    acc = 0.0
    parts = []
    for v, w in zip(values[:-1], weights[:-1]):
        acc += w / total
        parts.append(f"WHEN {x} < CAST({round(acc, 12)!r} AS DOUBLE) THEN {_lit(v)}")
    if not parts:
        return _lit(values[-1])
    return "(CASE " + " ".join(parts) + f" ELSE {_lit(values[-1])} END)"


def weighted(key, tag: str, values: list[str], weights: list[float]) -> Column:
    """Weighted choice as a generated CASE over cumulative weights (J9 for few categories)."""
    return F.expr(weighted_expr(key, tag, values, weights))


# ---- DuckDB twins -------------------------------------------------------

def u_sql(key_sql: str, tag: str) -> str:
    return (f"(cast('0x' || substr(md5(cast({key_sql} as varchar) || ':{tag}'), 1, 8) as bigint)"
            f" / 4294967296.0)")


def pick_sql(key_sql: str, tag: str, values: list[str]) -> str:
    arr = "[" + ", ".join(_q(v) for v in values) + "]"
    return f"({arr})[cast(floor({u_sql(key_sql, tag)} * {len(values)}) as integer) + 1]"


def weighted_sql(key_sql: str, tag: str, values: list[str], weights: list[float]) -> str:
    x = u_sql(key_sql, tag)
    total = float(sum(weights))
    acc = 0.0
    parts = []
    for v, w in zip(values[:-1], weights[:-1]):
        acc += w / total
        parts.append(f"WHEN {x} < {round(acc, 12)!r} THEN {_q(v)}")
    if not parts:
        return _q(values[-1])
    return "(CASE " + " ".join(parts) + f" ELSE {_q(values[-1])} END)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
