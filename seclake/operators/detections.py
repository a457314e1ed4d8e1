"""Row-level detections over normalized events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import network
from ..functions.pin import pin
from ..functions.text import EVENT_TEXT, JOINED_TEXT, has_any, present, q

_TYPE = "lower(coalesce(event_type, ''))"
_HEAD = 60  # characters of the message shown in an item
_ITEMS = {
    "privilege_escalation": f"concat(coalesce(timestamp, '?'), ' - ', coalesce(user, '?'), ' - ', left(_msg, {_HEAD}))",
    "lateral_movement": f"concat(coalesce(timestamp, '?'), ' - ', coalesce(source_ip, '?'), ' -> ', left(_msg, {_HEAD}))",
    "data_exfiltration": f"concat(coalesce(timestamp, '?'), ' - ', coalesce(source_ip, ''), ' - ', left(_msg, {_HEAD}))",
}


def type_has(*words: str) -> str:
    return has_any(_TYPE, words)


FAILED_LOGIN = type_has("fail")


def failed_logins(events: DataFrame) -> DataFrame:
    return events.where(FAILED_LOGIN)


def auth_failures(events: DataFrame) -> DataFrame:
    """Events whose text speaks of a failure, an invalid name or a denial."""
    text = pin(events, _text=f"lower({EVENT_TEXT})")
    return text.where(has_any("_text", fixed.AUTH_FAILURE_WORDS)).drop("_text")


def new_accounts(events: DataFrame) -> DataFrame:
    types = ", ".join(q(t) for t in fixed.NEW_ACCOUNT_TYPES)
    return events.where(f"event_type in ({types})").selectExpr(
        "seq", "timestamp", "user",
        "concat(coalesce(user, 'unknown'), ' created on ', coalesce(timestamp, '')) as item",
    )


def suspicious_ips(events: DataFrame) -> DataFrame:
    """Distinct addresses from suspicious ranges with their label."""
    return (
        events.selectExpr("source_ip", f"{network.suspicious_origin('source_ip')} as origin")
        .where("origin is not null")
        .distinct()
        .selectExpr("source_ip", "origin", "concat(source_ip, ' (', origin, ')') as item")
    )


def _by_words(events: DataFrame, words: tuple) -> DataFrame:
    type_words, text_words = words
    text = pin(events, _msg=EVENT_TEXT, _low="lower(_msg)")
    return text.where(f"{type_has(*type_words)} or {has_any('_low', text_words)}")


# What the lists of a triage show of an event, by list: test and item, over ``_msg`` and ``_low``.
def _listed() -> dict[str, tuple[str, str]]:
    types = ", ".join(q(t) for t in fixed.NEW_ACCOUNT_TYPES)

    def by_words(words: tuple) -> str:
        return f"{type_has(*words[0])} or {has_any('_low', words[1])}"

    return {
        "new_accounts": (f"event_type in ({types})", "concat(coalesce(user, 'unknown'), ' created on ', coalesce(timestamp, ''))"),
        "privilege_escalation": (by_words(fixed.PRIVILEGE_WORDS), _ITEMS["privilege_escalation"]),
        "lateral_movement": (by_words(fixed.LATERAL_WORDS), _ITEMS["lateral_movement"]),
        "data_exfiltration": (by_words(fixed.EXFIL_WORDS), _ITEMS["data_exfiltration"]),
    }


def findings(events: DataFrame) -> DataFrame:
    """(check, seq, item): the lists of new accounts, escalations, lateral movement and exfiltration in one scan."""
    text = pin(events, _msg=EVENT_TEXT, _low="lower(_msg)")
    entries = ", ".join(f"case when {test} then struct({q(name)} as check, {item} as item) end" for name, (test, item) in _listed().items())
    return text.selectExpr("seq", f"explode(array_compact(array({entries}))) as f").selectExpr("f.check", "seq", "f.item")


def privilege_escalation(events: DataFrame) -> DataFrame:
    return _by_words(events, fixed.PRIVILEGE_WORDS).selectExpr(
        "seq", "timestamp", "user", f"{_ITEMS['privilege_escalation']} as item",
    )


def lateral_movement(events: DataFrame) -> DataFrame:
    return _by_words(events, fixed.LATERAL_WORDS).selectExpr(
        "seq", "timestamp", "source_ip", f"{_ITEMS['lateral_movement']} as item",
    )


def data_exfiltration(events: DataFrame) -> DataFrame:
    return _by_words(events, fixed.EXFIL_WORDS).selectExpr(
        "seq", "timestamp", "source_ip", f"{_ITEMS['data_exfiltration']} as item",
    )


def attack_phases(events: DataFrame) -> DataFrame:
    """Events per attack phase; an event counts in every phase it has a word of."""
    low = pin(events, _low=f"lower({JOINED_TEXT})", _type=_TYPE)
    hits = ", ".join(
        f"case when {has_any('_low', words)} or {has_any('_type', words)} "
        f"then struct({i} as position, {q(phase)} as phase) end"
        for i, (phase, words) in enumerate(fixed.PHASE_WORDS.items(), start=1)
    )
    return (
        low.selectExpr(f"explode(array_compact(array({hits}))) as p")
        .selectExpr("p.position", "p.phase")
        .groupBy("position", "phase")
        .count()
        .withColumnRenamed("count", "events")
        .orderBy("position")
    )


def geo_distribution(events: DataFrame) -> DataFrame:
    """Events per coarse origin of the source address, most frequent first."""
    counts = events.where(present("source_ip")).groupBy("source_ip").agg(F.count("*").alias("events"))
    return origins(counts)


def origins(counts: DataFrame) -> DataFrame:
    """``geo_distribution`` from (source_ip, events)."""
    return (
        counts.selectExpr(f"{network.geo_class('source_ip')} as origin", "events")
        .groupBy("origin")
        .agg(F.sum("events").alias("events"))
        .orderBy("events", "origin", ascending=[False, True])
    )
