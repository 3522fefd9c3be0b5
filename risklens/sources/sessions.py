"""Scan sessions and lookups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens.operators.ordering import latest_by


def latest_scan(scans: DataFrame, key: str = "session_id", ts: str = "scanned_at", tie: str = "scan_id") -> DataFrame:
    """The live scan of every session: a new scan replaces the old one."""
    return latest_by(scans, [key], [F.col(ts).desc(), F.col(tie).desc()])


def drop_session(scans: DataFrame, session_id: str, key: str = "session_id") -> DataFrame:
    return scans.filter(F.col(key) != session_id)


def findings_for(df: DataFrame, session_id: str, finding_id: int | None = None,
                 key: str = "project_name", item: str = "seq") -> DataFrame:
    """Findings of a session, or the one with the given number; no match is empty."""
    rows = df.filter(F.col(key) == session_id)
    return rows if finding_id is None else rows.filter(F.col(item) == finding_id)
