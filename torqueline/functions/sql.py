"""Small helpers to write an expression as SQL text.

Wide statistics need hundreds of expressions; as text they reach Spark in one call
rather than one call per operator.
"""

from __future__ import annotations

import math


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float | None) -> str:
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    value = float(value)
    if math.isinf(value) or math.isnan(value):
        return f"CAST('{value}' AS DOUBLE)"
    return f"{value!r}D"


def struct(**parts: str) -> str:
    return "struct(" + ", ".join(f"{v} AS {name(k)}" for k, v in parts.items()) + ")"
