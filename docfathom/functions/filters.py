"""Filter dictionaries as columns: {"a": 1}, {"a": {"$lte": 2}}, {"$and": [...]}, {"$or": [...]}."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v),
}


def compiled(where: dict | None, json: str | None = None) -> Column:
    """A column of typed fields, so that it reaches the scan; json names a column of metadata text instead."""
    if not where:
        return F.lit(True)
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [compiled(w, json) for w in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner))
            continue
        if key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        column = F.get_json_object(json, f"$.{key}") if json else F.col(key)
        if not isinstance(value, dict):
            value = {"$eq": value}
        for op, v in value.items():
            if op not in COMPARE:
                raise ValueError(f"unknown operator {op}")
            typed = column.cast("double") if json and isinstance(v, (int, float)) and not isinstance(v, bool) else column
            parts.append(COMPARE[op](typed, v))
    return reduce(lambda a, b: a & b, parts)
