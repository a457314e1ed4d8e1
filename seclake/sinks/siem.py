"""Documents for search and log platforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.severity import stored_severity
from ..functions.text import EVENT_TEXT, q


def to_siem_docs(events: DataFrame) -> DataFrame:
    """One document row per event, with dotted field names."""

    def text(name: str, default: str = "") -> str:
        return f"coalesce({name}, {q(default)})"

    return events.selectExpr(
        f"{text('timestamp')} as `@timestamp`",
        "'event' as `event.kind`",
        "'authentication' as `event.category`",
        f"{text('event_type', 'unknown')} as `event.type`",
        f"{stored_severity(events)} as `log.level`",
        f"{EVENT_TEXT} as message",
        f"{text('source_ip')} as `source.ip`",
        f"{text('destination_ip')} as `destination.ip`",
        f"{text('user')} as `user.name`",
        f"{text('host')} as `host.name`",
        f"{text('host', 'unknown')} as `log.source.name`",
        f"{text('mitre_tactic')} as mitre_tactic",
        f"{text('mitre_technique')} as mitre_technique",
    )


def _doc(docs: DataFrame) -> str:
    return "struct(" + ", ".join(f"`{c}`" for c in docs.columns) + ")"


def to_docs(docs: DataFrame) -> DataFrame:
    """Each document as one JSON text."""
    return docs.selectExpr(f"to_json({_doc(docs)}) as value")


def to_bulk_ndjson(docs: DataFrame, index: str = "security-logs") -> DataFrame:
    """Action line and document line per event, kept together in one value."""
    action = f"to_json(struct(struct({q(index)} as _index) as index))"
    return docs.selectExpr(f"concat({action}, '\\n', to_json({_doc(docs)})) as value")


def to_hec(
    docs: DataFrame,
    index: str = "security",
    source: str = "seclake",
    sourcetype: str = "seclake:json",
) -> DataFrame:
    """Event collector payloads."""
    return docs.selectExpr(
        f"to_json(struct({_doc(docs)} as event, `host.name` as host, {q(index)} as index, "
        f"{q(source)} as source, {q(sourcetype)} as sourcetype)) as value"
    )


Formatter = Callable[[DataFrame], DataFrame]

FORMATTERS: dict[str, Formatter] = {
    "elasticsearch": to_bulk_ndjson,
    "splunk": to_hec,
    "sumologic": to_docs,
}


def register_target(name: str, formatter: Formatter) -> None:
    """Add an export target: documents in, one column ``value`` out."""
    FORMATTERS[name.lower()] = formatter


def export(events: DataFrame, target: str, path: str) -> dict:
    """Write the payloads of a target as text files and report what was written.

    The count is taken while writing.
    """
    formatter = FORMATTERS.get(target.lower())
    if formatter is None:
        return {"status": "unknown_provider", "message": f"Unknown provider: {target}"}
    seen = Observation("export")
    payloads = formatter(to_siem_docs(events))
    counted = payloads.observe(
        seen,
        F.count("*").alias("total"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("failed"),
    )
    counted.where(F.col("value").isNotNull()).write.text(path)
    total, failed = seen.get["total"], seen.get["failed"]
    if total == 0:
        return {"status": "no_events", "exported": 0}
    status = "success" if failed == 0 else "partial"
    return {"status": status, "exported": total - failed, "failed": failed}
