"""Alert rows and tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.severity import severity_rank
from ..functions.text import EVENT_TEXT, lookup, q


def passes(severity: str, threshold: str = "low") -> str:
    """Whether a severity reaches the threshold (an unknown threshold counts as low)."""
    return f"{severity_rank(f'lower({severity})')} <= {fixed.SEVERITY_RANK.get(threshold, 3)}"


def severe_only(scored: DataFrame) -> DataFrame:
    """Events of the three upper levels, as the live views show them."""
    return scored.where("severity in ('critical', 'high', 'medium')")


def to_alerts(
    scored: DataFrame, threshold: str = "low", show_all: bool = False, length: int | None = 100
) -> DataFrame:
    """Alert rows of the scored events which reach the threshold.

    The message is cut after ``length`` characters for display; None keeps all of it,
    as tickets want it.
    """
    message = EVENT_TEXT if length is None else f"left({EVENT_TEXT}, {length})"
    rows = scored if show_all else scored.where(passes("severity", threshold))
    keep = [c for c in ("seq", "event_ts") if c in scored.columns]
    return rows.selectExpr(
        *keep,
        "coalesce(nullif(timestamp, ''), date_format(current_timestamp(), 'MMM dd HH:mm:ss')) as timestamp",
        "upper(severity) as severity",
        "coalesce(source_ip, '') as source_ip",
        "coalesce(user, '') as user",
        f"{message} as message",
    )


def last_alerts(alerts: DataFrame, keep: int = 50) -> DataFrame:
    """The newest alerts."""
    return alerts.orderBy(F.desc("seq")).limit(keep)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Alerts per severity and in total (``TOTAL``)."""
    return (
        alerts.rollup("severity")
        .agg(F.count("*").alias("alerts"))
        .selectExpr("coalesce(severity, 'TOTAL') as severity", "alerts")
    )


def to_tickets(
    alerts: DataFrame,
    title: str = "Security alert",
    tags: tuple[str, ...] = (),
    default_priority: str = "P3",
    service: str = "seclake",
    workflow: bool = False,
) -> DataFrame:
    """Ticket rows of alerts, made with ``length=None`` for the whole text.

    ``service`` is the first tag.  ``workflow=True`` adds source, category and an open
    status, as workflow systems want them.
    """
    severity = "lower(severity)"
    labels = ", ".join(q(t) for t in (service, *tags))
    extra = [
        f"{q(service)} as source",
        f"coalesce({lookup(fixed.TICKET_CATEGORY, severity)}, {q(fixed.TICKET_CATEGORY_DEFAULT)}) as category",
        "'open' as status",
    ]
    return alerts.selectExpr(
        *(["seq"] if "seq" in alerts.columns else []),
        f"{q(title)} as title",
        "message as description",
        "upper(severity) as severity",
        f"coalesce({lookup(fixed.TICKET_PRIORITY, severity)}, {q(default_priority)}) as priority",
        "source_ip",
        "user",
        f"array_distinct(array({labels})) as tags",
        "current_timestamp() as created_at",
        *(extra if workflow else []),
    )
