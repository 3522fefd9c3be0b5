"""Classes of service errors, from their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has_any(text: Column, parts: list[str]) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(text, F.lit(part))
    return found


def classify_error(c: Column) -> Column:
    """rate_limit, timeout, connection or non_retryable; the first match wins."""
    text = F.lower(c)
    return F.when(c.isNotNull(), (
        F.when(_has_any(text, ["rate limit", "429", "too many requests"]), "rate_limit")
        .when(_has_any(text, ["timeout"]), "timeout")
        .when(_has_any(text, ["connection"]), "connection")
        .otherwise("non_retryable")
    ))


def is_retryable(c: Column) -> Column:
    """Whether the text of an error asks for another try."""
    parts = ["rate limit", "too many requests", "429", "quota exceeded", "timeout"]
    return F.coalesce(_has_any(F.lower(c), parts), F.lit(False))
