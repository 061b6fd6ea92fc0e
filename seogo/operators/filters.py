"""Metadata filters: a small dictionary language compiled to null-safe Columns."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _value(df: DataFrame, key: str) -> tuple[Column, bool]:
    """The column of a key and whether it is JSON-encoded: own column, else an entry of ``extra``."""
    if key in df.columns:
        return F.col(key), False
    if "extra" in df.columns:
        return F.col("extra")[key], True
    return F.lit(None).cast("string"), False


def _same(value: Column, encoded: bool, kind: str, expected: Any) -> Column:
    if encoded:
        # scalars stored as JSON keep their types apart; plain strings of older rows compare as such
        options = [json.dumps(expected, ensure_ascii=False)] + ([expected] if isinstance(expected, str) else [])
        return F.coalesce(value.isin(*options), F.lit(False)) if expected is not None else value.isNull()
    if expected is None:
        return value.isNull()
    if (kind == "string") != isinstance(expected, str):
        return F.lit(False)  # a text never equals a number
    return value.eqNullSafe(F.lit(expected))


def compile_where(df: DataFrame, where: dict[str, Any] | None) -> Column:
    """A predicate over ``df``: keys and the operators of one key are all required.

    ``$and``/``$or`` take lists; per key a plain value, ``$eq``, ``$ne``, ``$in`` or ``$nin``. A missing key is
    null: ``$ne`` and ``$nin`` hold for it. Operators that are not known raise ValueError.
    """
    kinds = dict(df.dtypes)
    clauses: list[Column] = [F.lit(True)]
    for key, condition in (where or {}).items():
        if key in ("$and", "$or"):
            clauses.append(reduce(and_ if key == "$and" else or_, (compile_where(df, c) for c in condition), F.lit(key == "$and")))
            continue
        if key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        value, encoded = _value(df, key)
        same = lambda x, v=value, e=encoded, k=kinds.get(key, "string"): _same(v, e, k, x)
        for op, expected in condition.items() if isinstance(condition, dict) else [("$eq", condition)]:
            among = lambda xs: reduce(or_, (same(x) for x in xs), F.lit(False))
            match op:
                case "$eq":
                    clauses.append(same(expected))
                case "$ne":
                    clauses.append(~same(expected))
                case "$in":
                    clauses.append(among(expected))
                case "$nin":
                    clauses.append(~among(expected))
                case _:
                    raise ValueError(f"unknown operator {op}")
    return reduce(and_, clauses)


def combined(where: dict | None, source_types: list[str] | None = None, source_ids: list[str] | None = None) -> dict | None:
    """One filter of the caller's and of lists of types and ids; null if there is none."""
    parts = [c for c in (where, {"source_type": {"$in": list(source_types)}} if source_types else None, {"source_id": {"$in": list(source_ids)}} if source_ids else None) if c]
    return {"$and": parts} if len(parts) > 1 else parts[0] if parts else None
