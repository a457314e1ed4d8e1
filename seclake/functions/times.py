"""Time expressions over the textual event time."""

from __future__ import annotations

from .text import q

CLOCK = "yyyy-MM-dd HH:mm:ss"


def event_time(text: str, year: int | str | None) -> str:
    """Timestamp of an event.

    ISO-8601 text is cast.  Header times carry no year, so one must be given (a
    number or an expression); without it they stay NULL.
    """
    is_iso = f"rlike({text}, {q(r'^\d{4}-')})"
    iso = f"try_to_timestamp({text})"
    if year is None:
        return f"case when {is_iso} then {iso} end"
    single_blank = f"regexp_replace({text}, {q(r'\s+')}, ' ')"
    header = f"try_to_timestamp(concat(cast({year} as string), ' ', {single_blank}), 'yyyy MMM d H:m:s')"
    return f"case when {is_iso} then {iso} else {header} end"


def _last_token(text: str) -> str:
    return f"try_element_at(split(trim({text}), {q(r'\s+')}), -1)"


def hour_before_colon(text: str) -> str:
    """Hour as the anomaly checks read it.

    Last blank-separated token before the first colon.  Text without a colon
    counts as hour 0; text which is no number (ISO times) gives NULL.
    """
    token = _last_token(f"substring_index({text}, ':', 1)")
    return (
        f"case when coalesce({text}, '') = '' then null "
        f"when contains({text}, ':') then try_cast({token} as int) else 0 end"
    )


def hour_of_last_token(text: str) -> str:
    """Hour as the hourly histogram reads it: the last token up to its first colon.

    Text of blanks only counts as hour 0.
    """
    return (
        f"case when coalesce({text}, '') = '' then null when trim({text}) = '' then 0 "
        f"else try_cast(substring_index({_last_token(text)}, ':', 1) as int) end"
    )


def clock(ts: str) -> str:
    return f"date_format({ts}, {q(CLOCK)})"


def clock_of_second(second: str) -> str:
    return clock(f"timestamp_seconds({second})")
