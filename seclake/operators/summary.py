"""Counts, distributions and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import times
from ..functions.severity import mitre_text, stored_severity
from ..functions.text import present, q
from ..session import literal_table


def bar_length(value: str, largest: str, width: int) -> str:
    """Length of a bar for ``value`` when ``largest`` fills ``width``."""
    share = f"try_divide(cast({value} as double), cast({largest} as double)) * {width}"
    return f"cast(coalesce(floor({share}), 0) as bigint)"


def overview(events: DataFrame) -> DataFrame:
    """Number of events, distinct users and distinct source addresses."""
    return events.selectExpr(
        "count(*) as total_events",
        "count(distinct nullif(source_ip, '')) as unique_ips",
        "count(distinct nullif(user, '')) as unique_users",
    )


def distinct_values(events: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values of a column, with their event counts."""
    return (
        events.where(present(column))
        .selectExpr(f"{column} as value")
        .groupBy("value")
        .agg(F.count("*").alias("events"))
    )


def event_summary(events: DataFrame) -> DataFrame:
    return distinct_values(events, "event_type").withColumnRenamed("value", "event_type")


def severity_counts(scored: DataFrame) -> DataFrame:
    """Total and events per level in one row, levels without events being 0."""
    return scored.selectExpr(
        "count(*) as total_events",
        *[f"count_if(severity = {q(level)}) as {level}" for level in fixed.SEVERITIES],
    )


def severity_distribution(events: DataFrame, width: int = 40) -> DataFrame:
    """Events and percentage per level, from the stored severity; other names are ignored."""
    counts = (
        events.selectExpr(f"lower({stored_severity(events)}) as severity")
        .groupBy("severity")
        .agg(F.count("*").alias("n"))
    )
    return shares(counts, width)


def shares(counts: DataFrame, width: int = 40) -> DataFrame:
    """``severity_distribution`` from (severity, n)."""
    levels = literal_table(
        counts.sparkSession, "position, severity", [f"({i}, {q(s)})" for i, s in enumerate(fixed.SEVERITIES)]
    )
    return (
        levels.join(counts, "severity", "left")
        # five rows
        .selectExpr("position", "severity", "coalesce(n, 0) as events", "sum(n) over () as total")
        .selectExpr("position", "severity", "events",
                    "try_divide(events * 100.0D, total) as percent",
                    f"{bar_length('events', 'total', width)} as bar")
        .orderBy("position")
    )


def hourly_timeline(events: DataFrame, width: int = 60) -> DataFrame:
    """Events per hour of day, all 24 hours; hours outside 0-23 only scale the bars."""
    counts = (
        events.selectExpr(f"{times.hour_of_last_token('timestamp')} as hour")
        .where("hour is not null")
        .groupBy("hour")
        .agg(F.count("*").alias("n"))
    )
    return dense_hours(counts, width)


def dense_hours(counts: DataFrame, width: int = 60) -> DataFrame:
    """``hourly_timeline`` from (hour, n)."""
    hours = counts.sparkSession.range(24).selectExpr("cast(id as int) as hour")
    return (
        hours.join(counts, "hour", "full")
        # one row per hour
        .selectExpr("hour", "coalesce(n, 0) as events", "max(n) over () as largest")
        .selectExpr("hour", "events", f"{bar_length('events', 'largest', width)} as bar")
        .where("hour between 0 and 23")
        .orderBy("hour")
    )


def top_values(
    events: DataFrame, column: str, limit: int = 10, width: int = 30, label: int | None = None
) -> DataFrame:
    """Most frequent non-empty values; among equals the one seen first comes first."""
    counts = (
        events.where(present(column))
        .selectExpr(f"{column} as value", "seq")
        .groupBy("value")
        .agg(F.count("*").alias("events"), F.min("seq").alias("first"))
    )
    return top_counts(counts, limit, width, label)


def top_counts(counts: DataFrame, limit: int = 10, width: int = 30, label: int | None = None) -> DataFrame:
    """``top_values`` from (value, events, first)."""
    ranked = counts.orderBy(F.desc("events"), "first").limit(limit)
    return (
        # at most ``limit`` rows
        ranked.selectExpr("value", "events", "max(events) over () as largest")
        .selectExpr(f"left(value, {label}) as value" if label else "value", "events",
                    f"{bar_length('events', 'largest', width)} as bar")
    )


def top_sources(events: DataFrame, limit: int = 10) -> DataFrame:
    return top_values(events, "source_ip", limit)


def top_users(events: DataFrame, limit: int = 10) -> DataFrame:
    return top_values(events, "user", limit)


def top_event_types(events: DataFrame, limit: int = 15) -> DataFrame:
    return top_values(events, "event_type", limit, label=20)


def mitre_tactics(events: DataFrame) -> DataFrame:
    """Events per tactic code with its text, ``Unknown`` for codes without one."""
    return described_tactics(distinct_values(events, "mitre_tactic"))


def described_tactics(counts: DataFrame) -> DataFrame:
    """``mitre_tactics`` from (value, events)."""
    return counts.selectExpr(
        "value as mitre_tactic", "events", f"coalesce({mitre_text('value')}, 'Unknown') as description"
    ).orderBy("mitre_tactic")


def mitre_samples(events: DataFrame, limit: int = 5) -> DataFrame:
    """The first tagged events as ``code: text``; events without a text are passed over."""
    # The code table is consulted only when the event has no technique field at all.
    text = f"coalesce(mitre_technique, {mitre_text('mitre_tactic')}, '')"
    return (
        events.where(present("mitre_tactic"))
        .selectExpr("seq", "mitre_tactic", f"{text} as technique")
        .where("technique <> ''")
        .orderBy("seq")
        .limit(limit)
        .selectExpr("seq", "concat(mitre_tactic, ': ', technique) as sample")
    )


def events_per_minute(events: DataFrame) -> DataFrame:
    """Events per minute of event time (minutes without events are absent)."""
    return (
        events.where("event_ts is not null")
        .selectExpr("date_trunc('minute', event_ts) as minute")
        .groupBy("minute")
        .agg(F.count("*").alias("events"))
    )


def display_view(events: DataFrame) -> DataFrame:
    """The six columns of the table view, details cut after 50 characters."""
    shown = [f"coalesce({c}, '') as {c}" for c in ("timestamp", "host", "user", "source_ip", "event_type")]
    cut = "if(length(_raw) > 50, concat(left(_raw, 50), '...'), _raw) as details"
    return events.selectExpr("seq", *shown, "coalesce(raw_message, '') as _raw").selectExpr(
        "seq", "timestamp", "host", "user", "source_ip", "event_type", cut
    )
