"""What summaries count, in one scan.

Each event is one row for every facet it has: the total, its severity, type, address, user, tactic, hour and phases.
Grouped by facet and value these rows are a narrow table of counts, from which the tables of reports and dashboards
follow without another look at the events.  Counts are made before the shuffle, so a value which most events
share costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import times
from ..functions.pin import pin
from ..functions.severity import SEVERITY_TEXT, severity_of, stored_severity
from ..functions.text import JOINED_TEXT, has_any, q
from .detections import FAILED_LOGIN

TOTAL, SEVERITY, STORED, TYPE, SOURCE, USER, TACTIC, HOUR, PHASE, FAILING = (
    "total", "severity", "stored", "type", "source", "user", "tactic", "hour", "phase", "failing")


def facet_counts(events: DataFrame) -> DataFrame:
    """(facet, value, events, first): events of each value of each facet, and the first one's order value."""
    text = pin(events, _scored=SEVERITY_TEXT, _joined=f"lower({JOINED_TEXT})", _type="lower(coalesce(event_type, ''))",
               _hour=times.hour_of_last_token("timestamp"))
    known = [
        (TOTAL, "''"),
        (SEVERITY, severity_of("_scored")),
        (STORED, f"lower({stored_severity(events)})"),
        (HOUR, "cast(_hour as string)"),
        (FAILING, f"if({FAILED_LOGIN}, nullif(source_ip, ''), null)"),
        *[(facet, f"nullif({column}, '')") for facet, column in (
            (TYPE, "event_type"), (SOURCE, "source_ip"), (USER, "user"), (TACTIC, "mitre_tactic"))],
        *[(PHASE, f"if({has_any('_joined', words)} or {has_any('_type', words)}, {q(phase)}, null)") for phase, words in fixed.PHASE_WORDS.items()],
    ]
    # values are columns first: generated code computes them, and no function of arrays keeps the explode from it
    values = text.selectExpr("seq", *[f"{value} as _v{i}" for i, (_, value) in enumerate(known)])
    entries = ", ".join(f"struct({q(facet)} as facet, _v{i} as value)" for i, (facet, _) in enumerate(known))
    return (
        values.selectExpr("seq", f"explode(array({entries})) as f")
        .where("f.value is not null")
        .groupBy("f.facet", "f.value")
        .agg(F.count("*").alias("events"), F.min("seq").alias("first"))
    )


def of(counts: DataFrame, facet: str, name: str = "value") -> DataFrame:
    """The values of one facet as (``name``, events, first)."""
    return counts.where(F.col("facet") == facet).select(F.col("value").alias(name), "events", "first")
