"""Failed-login bursts and attack sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..session import materialize
from .detections import failed_logins
from .ordering import count_ahead

DAY = 86_400


# Who an event is attributed to: its source address, else its user.
SOURCE = "coalesce(nullif(source_ip, ''), user, '')"


def failed_login_bursts(events: DataFrame, threshold: int = 5) -> DataFrame:
    """Distinct ``(source, attempts)`` of failed logins followed by related ones.

    For each failed row: itself plus all later failed rows with the same address
    or the same user, empty values being equal to each other.  By inclusion and
    exclusion this is 1 + later(ip) + later(user) - later(ip and user), so three
    counts replace the comparison of all pairs.
    """
    # One stream of keys serves all three counts: blocks and ranges of the order are made once.
    keys = ("struct('i' as kind, coalesce(source_ip, '') as ip, '' as user)", "struct('u' as kind, '' as ip, coalesce(user, '') as user)",
            "struct('b' as kind, coalesce(source_ip, '') as ip, coalesce(user, '') as user)")
    rows = materialize(failed_logins(events).selectExpr("seq", f"inline(array({', '.join(keys)}))"), "failed-logins")
    counted = count_ahead(rows, ["kind", "ip", "user"], "later")
    return (
        counted.groupBy("seq")
        .agg(F.expr("1 + sum(if(kind = 'b', -later, later)) as attempts"), F.max("ip").alias("ip"), F.max("user").alias("user"))
        .selectExpr("coalesce(nullif(ip, ''), user) as source", "attempts")
        .where(f"source <> '' and attempts >= {threshold}")
        .distinct()
        .selectExpr("source", "attempts", "concat(source, ': ', attempts, ' failed attempts') as item")
    )


def count_per_second(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, second, n): at most one row per key and second, however hot the key is."""
    return (
        rows.selectExpr(*keys, "unix_timestamp(event_ts) as second")
        .groupBy(*keys, "second")
        .agg(F.count("*").alias("n"))
    )


def trailing_counts(per_second: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Add ``in_window`` to (keys, second, n): events of the key in the last ``seconds``.

    The seconds of a key are cut into day blocks; the end of a block is repeated at
    the start of the next one, so that no sort group spans more than a block and
    every frame is complete.  Events without a time are one row per key, a window of
    their own.
    """
    block = max(DAY, seconds)
    own = f"floor(second / {block})"
    reaches_next = f"coalesce(pmod(second, {block}) >= {block - seconds}, false)"
    blocks = f"explode(if({reaches_next}, array({own}, {own} + 1), array({own}))) as _block"
    frame = Window.partitionBy(*keys, "_block").orderBy("second").rangeBetween(-seconds, 0)
    return (
        per_second.selectExpr("*", blocks)
        .withColumn("in_window", F.sum("n").over(frame))
        .where(f"_block <=> {own}")
        .drop("_block")
    )


def failed_login_bursts_windowed(
    events: DataFrame, threshold: int = 5, minutes: int = 10
) -> DataFrame:
    """Sources with at least ``threshold`` failed logins inside ``minutes``.

    One row per source: the highest count of any window, the second the threshold
    was first met, and the number of failed logins at which it was met.  Failed logins
    without a time count as one window of their source.
    """
    rows = failed_logins(events).selectExpr(f"{SOURCE} as source", "event_ts").where("source <> ''")
    counts = trailing_counts(count_per_second(rows, ["source"]), ["source"], minutes * 60)
    return (
        counts.where(f"in_window >= {threshold}")
        .groupBy("source")
        .agg(
            F.max("in_window").alias("peak"),
            F.min("second").alias("first_second"),
            F.sum("n").alias("attempts_over"),
        )
        .selectExpr(
            "source", "peak", f"{times.clock_of_second('first_second')} as first_at", "attempts_over"
        )
    )


def attack_sessions(events: DataFrame, gap_minutes: int = 10) -> DataFrame:
    """Failed logins per source, split where it pauses for ``gap_minutes`` or more.

    Rows within one gap-sized time slot always belong together, so a slot is first
    folded to its first second, last second and count; only slots are then put in
    order per source.  Failed logins without a time are one session without times.
    """
    gap = gap_minutes * 60
    slots = (
        failed_logins(events)
        .selectExpr(f"{SOURCE} as source", "unix_timestamp(event_ts) as second")
        .where("source <> ''")
        .selectExpr("source", "second", f"floor(second / {gap}) as slot")
        .groupBy("source", "slot")
        .agg(F.min("second").alias("first"), F.max("second").alias("last"),
             F.count("*").alias("n"))
    )
    by_time = Window.partitionBy("source").orderBy("slot")
    return (
        slots.withColumn("before", F.lag("last").over(by_time))
        .selectExpr("*", f"int(before is null or first - before >= {gap}) as starts")
        .withColumn("session", F.sum("starts").over(by_time))
        .groupBy("source", "session")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"),
             F.sum("n").alias("attempts"))
        .selectExpr(
            "source",
            f"{times.clock_of_second('first')} as started_at",
            f"{times.clock_of_second('last')} as last_at",
            "attempts",
        )
    )
