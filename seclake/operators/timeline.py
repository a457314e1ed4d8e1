"""Chronological views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.severity import severity_rank
from ..functions.text import EVENT_TEXT
from .parse import score


def timeline(events: DataFrame, order: str = "text") -> DataFrame:
    """All events with severity and a short message, in time order.

    ``order="text"`` sorts the textual time as it stands, ``order="event_time"`` the
    parsed time; rows of equal time stay in input order.
    """
    if order not in ("text", "event_time"):
        raise ValueError("order must be 'text' or 'event_time'")
    return timeline_rows(events).orderBy("timestamp" if order == "text" else "event_ts", "seq")


def timeline_rows(events: DataFrame) -> DataFrame:
    return score(events).selectExpr(
        "seq",
        "event_ts",
        "coalesce(timestamp, '') as timestamp",
        "coalesce(host, 'unknown') as host",
        "coalesce(source_ip, '') as source_ip",
        "coalesce(user, '') as user",
        "coalesce(event_type, '') as event_type",
        "severity",
        f"left({EVENT_TEXT}, 100) as message",
    )


def timeline_by_severity(events: DataFrame, limit: int = 20) -> DataFrame:
    """The first rows of the timeline, most severe level first."""
    return (
        timeline_rows(events)
        .selectExpr("*", f"{severity_rank('severity')} as rank")
        .orderBy("rank", "timestamp", "seq")
        .limit(limit)
    )
