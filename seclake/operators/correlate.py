"""Grouping of related events into campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..functions.pin import pin
from ..functions.text import EVENT_TEXT, has_any, present, q
from ..schema import EVENT_FIELDS
from ..session import materialize
from .bursts import DAY
from .detections import failed_logins, type_has

# campaign -> word in the event type
_LISTED = {
    "privilege_escalation_attempts": "priv_esc",
    "lateral_movement_chains": "lateral",
    "exfiltration_campaigns": "exfil",
}


def brute_force_campaigns(events: DataFrame) -> DataFrame:
    """Failed logins per source address."""
    return (
        failed_logins(events)
        .where(present("source_ip"))
        .groupBy("source_ip")
        .agg(F.count("*").alias("attempts"))
    )


def listed_campaigns(events: DataFrame, first: int = 10) -> DataFrame:
    """The first events, in input order, of the campaigns named by the event type, as whole records."""
    order_columns = [c for c in ("file", "seq", "event_ts") if c in events.columns]
    tags = ", ".join(f"case when {type_has(word)} then {q(name)} end" for name, word in _LISTED.items())
    order = Window.partitionBy("campaign").orderBy("seq")
    return (
        events.selectExpr("*", f"explode(array_compact(array({tags}))) as campaign")
        .withColumn("position", F.row_number().over(order))
        .where(f"position <= {first}")
        .select("campaign", "position", *order_columns, *EVENT_FIELDS)
    )


def correlate(events: DataFrame, first: int = 10) -> DataFrame:
    """All campaigns in one table: (campaign, key, attempts, position, the event's columns).

    Brute force campaigns are totals per address and have no event.
    """
    return campaigns(brute_force_campaigns(events), listed_campaigns(events, first))


def campaigns(brute: DataFrame, listed: DataFrame) -> DataFrame:
    """``correlate`` from its two parts."""
    brute = brute.selectExpr("'brute_force_campaigns' as campaign", "source_ip as key", "attempts")
    listed = listed.selectExpr(
        "campaign", "coalesce(source_ip, '') as key", "1L as attempts", "* except (campaign)"
    )
    return brute.unionByName(listed, allowMissingColumns=True)


_HOST = r"((?:\d{1,3}\.){3}\d{1,3})"


def _probes(events: DataFrame) -> DataFrame:
    """``event_ts, scanner, host, port`` of probes.

    The scanner follows "from" or "src" in the text, the target "to" or "dst"; otherwise the event's own addresses
    are taken.  A port follows the target address after a colon.
    """

    def pick(words: str, fallback: str) -> str:
        found = f"regexp_extract(_low, {q(rf'(?:{words})\s+{_HOST}')}, 1)"
        return f"coalesce(nullif({found}, ''), {fallback}, '')"

    text = pin(events, _low=f"lower({EVENT_TEXT})")
    return (
        text.where(f"{type_has('scan')} or {has_any('_low', ('port scan',))}")
        .selectExpr(
            "event_ts",
            f"{pick('from|src', 'source_ip')} as scanner",
            f"nullif({pick('to|dst', 'destination_ip')}, '') as host",
            f"nullif(regexp_extract(_low, {q(r'(?:\d{1,3}\.){3}\d{1,3}:(\d+)')}, 1), '') as port",
        )
        .where("scanner <> ''")
    )


def port_scan_campaigns(
    events: DataFrame, minutes: int = 10, min_targets: int = 10
) -> DataFrame:
    """Sources which probe many ports or hosts inside one of the windows time is divided into.

    Duplicates fall away per (scanner, window, target)
    before the counts meet, so a single busy scanner is spread over its targets.
    """
    probes = _probes(events).selectExpr(
        f"window(event_ts, '{minutes} minutes').start as started", "scanner", "host", "port")
    targets = probes.groupBy("scanner", "started", "host", "port").agg(F.count("*").alias("n"))
    return (
        targets.groupBy("scanner", "started")
        .agg(
            F.count_distinct("host").alias("hosts"),
            F.count_distinct("port").alias("ports"),
            F.sum("n").alias("probes"),
        )
        .where(f"greatest(hosts, ports) >= {min_targets}")
        .selectExpr("scanner", f"{times.clock('started')} as started_at", "hosts", "ports", "probes")
    )


def port_scan_sliding(events: DataFrame, minutes: int = 10, min_targets: int = 10) -> DataFrame:
    """Sources which probe many ports or hosts inside any ``minutes``, wherever they begin.

    A target counts for its scanner from a sighting until the window has passed without another one.  Sightings
    within one window-sized slot belong together, so a slot is folded to its first and last second; slots which
    touch become one interval.  Running sums over the ends of the intervals give the number of different targets
    in the window that ends at each second; they are made by day and carried over by the sums of the days.

    One row per scanner: the highest numbers of hosts and of ports, the second at which either first reached
    ``min_targets``, and all its probes.  Probes without a time are left out.
    """
    window = minutes * 60
    seen = (
        _probes(events)
        .where("event_ts is not null")
        .selectExpr("scanner", "unix_timestamp(event_ts) as second",
                    "explode(array(struct('probe' as kind, '' as target), struct('host' as kind, host as target), "
                    "struct('port' as kind, port as target))) as t")
        .selectExpr("scanner", "t.kind", "t.target", "second", f"floor(second / {window}) as slot")
        .where("target is not null")
    )
    slots = materialize(
        seen.groupBy("scanner", "kind", "target", "slot").agg(
            F.min("second").alias("first"), F.max("second").alias("last"), F.count("*").alias("n")), "sightings")
    by_time = Window.partitionBy("scanner", "kind", "target").orderBy("slot")
    ends = (
        slots.where("kind <> 'probe'")
        .withColumn("before", F.lag("last").over(by_time))
        .withColumn("after", F.lead("first").over(by_time))
        .selectExpr("scanner", "kind", "explode(array_compact(array("
                    f"if(before is null or first > before + {window}, struct(first as second, 1L as step), null), "
                    f"if(after is null or after > last + {window}, struct(last + {window + 1} as second, -1L as step), null)))) as e")
        .groupBy("scanner", "kind", "e.second")
        .agg(F.sum("e.step").alias("step"))
        .selectExpr("*", f"floor(second / {DAY}) as day")
    )
    ends = materialize(ends, "interval-ends")
    earlier = Window.partitionBy("scanner", "kind").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = ends.groupBy("scanner", "kind", "day").agg(F.sum("step").alias("total")).select(
        "scanner", "kind", "day", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("carried"))
    running = Window.partitionBy("scanner", "kind", "day").orderBy("second").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = ends.withColumn("inside", F.sum("step").over(running)).join(days, ["scanner", "kind", "day"]).selectExpr(
        "scanner", "kind", "second", "inside + carried as targets")
    found = active.groupBy("scanner").agg(
        F.expr("coalesce(max(targets) filter (where kind = 'host'), 0) as hosts"),
        F.expr("coalesce(max(targets) filter (where kind = 'port'), 0) as ports"),
        F.expr(f"min(second) filter (where targets >= {min_targets}) as first"),
    ).where("first is not null")
    probes = slots.where("kind = 'probe'").groupBy("scanner").agg(F.sum("n").alias("probes"))
    return found.join(probes, "scanner").selectExpr(
        "scanner", f"{times.clock_of_second('first')} as first_at", "hosts", "ports", "probes")
