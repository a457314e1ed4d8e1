"""Lines to normalized events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats, severity, times

from ..functions.parsers import LineParser, default_parsers
from ..functions.pin import pin
from ..functions.text import first_case, q
from ..schema import EVENT_FIELDS
from ..session import materialize

# Up to this many files the per-file format table is small enough to broadcast.
BROADCAST_FILES = 50_000
SALTS = 64


def _fields(lines: DataFrame, parsers: dict[str, LineParser], year: int | str | None) -> DataFrame:
    """Add all event fields to lines which have a ``format`` column."""
    helpers, prepared = [], lines
    for name, parser in parsers.items():
        if parser.column_helper is not None:
            made = F.when(F.col("format") == name, parser.column_helper(F.col("line")))
            prepared = prepared.withColumn(f"_own_{name}", made)
        elif parser.helper is not None:
            helpers.append(f"case when format = {q(name)} then {parser.helper('line')} end as {name}")
    if helpers:
        prepared = pin(prepared, _help=f"struct({', '.join(helpers)})")

    def helper_name(name: str) -> str:
        return f"_own_{name}" if parsers[name].column_helper is not None else f"_help.{name}"

    by_format = {name: parser.fields("line", helper_name(name)) for name, parser in parsers.items()}

    def field(name: str) -> str:
        same: dict[str, list[str]] = {}  # formats by their expression
        for fmt, fields in by_format.items():
            if name in fields:
                same.setdefault(fields[name], []).append(q(fmt))
        arms = [(f"format in ({', '.join(fmts)})", sql) for sql, fmts in same.items()]
        return first_case(arms) if arms else "cast(null as string)"

    # Every job asks for the event type: it tells whether the line is an event at all.
    typed = pin(prepared, event_type=field("event_type"))
    parsed = typed.selectExpr(
        *lines.columns, *[n if n == "event_type" else f"{field(n)} as {n}" for n in EVENT_FIELDS]
    )
    return parsed.selectExpr("*", f"{times.event_time('timestamp', year)} as event_ts")


def _events(parsed: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    keep = [c for c in ("file", "seq") if c in parsed.columns]
    return parsed.where("event_type is not null").select(
        *keep, *extra, "format", "event_ts", *EVENT_FIELDS
    )


_DETECTED = formats.detect_format("line")


def parse_lines(
    lines: DataFrame,
    year: int | str | None = None,
    parsers: dict[str, LineParser] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Parse each line by its own format; unrecognised lines are tried as syslog.

    Stateless, so it serves streams and tables alike.  Lines without an event are
    left out (see ``rejects``).  ``keep`` names extra input columns to carry along.
    """
    parsers = parsers or default_parsers()
    formatted = pin(lines, format=f"coalesce({_DETECTED}, 'syslog')")
    return _events(_fields(formatted, parsers, year), keep)


def file_formats(lines: DataFrame) -> DataFrame:
    """Format of the first recognised line per file (files without one are absent)."""
    return (
        pin(lines, format=_DETECTED)
        .where(F.col("format").isNotNull())
        .groupBy("file")
        .agg(F.min_by("format", "seq").alias("file_format"))
    )


def with_file_format(lines: DataFrame) -> DataFrame:
    """Add ``format``: the line's own format, else the one its file starts with."""
    own = pin(lines, format=_DETECTED)
    by_file = materialize(file_formats(lines), "file-formats")
    small = by_file.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    if small:
        return (
            own.join(F.broadcast(by_file), "file", "left")
            .withColumn("format", F.coalesce("format", "file_format"))
            .select(*lines.columns, "format")
        )
    # Many files: only unrecognised lines travel, spread over salts since one file
    # may hold a large share of them.
    salted_files = by_file.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    unknown = (
        own.where(F.col("format").isNull())
        .drop("format")
        .withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int"))
        .join(salted_files, ["file", "_salt"], "left")
        .select(*lines.columns, F.col("file_format").alias("format"))
    )
    return own.where(F.col("format").isNotNull()).unionByName(unknown)


def parse_logs(
    lines: DataFrame,
    format: str = "auto",
    year: int | str | None = None,
    parsers: dict[str, LineParser] | None = None,
) -> DataFrame:
    """Parse whole files: one given format, or ``auto`` with the per-file fallback."""
    parsers = parsers or default_parsers()
    return _events(_fields(_formatted(lines, format, parsers), parsers, year))


def rejects(
    lines: DataFrame, format: str = "auto", parsers: dict[str, LineParser] | None = None
) -> DataFrame:
    """Lines which yield no event, with the reason."""
    parsers = parsers or default_parsers()
    parsed = _fields(_formatted(lines, format, parsers), parsers, None)
    reason = F.when(F.col("format").isNull(), "unknown_format").otherwise("no_match")
    return parsed.where(F.col("event_type").isNull()).select(
        *lines.columns, "format", reason.alias("reason")
    )


def _formatted(lines: DataFrame, format: str, parsers: dict[str, LineParser]) -> DataFrame:
    if format == "auto":
        return with_file_format(lines)
    if format not in parsers:
        raise ValueError(f"unknown format {format!r}, expected auto or one of {sorted(parsers)}")
    return lines.withColumn("format", F.lit(format))


def score(events: DataFrame) -> DataFrame:
    """Add the ``severity`` column."""
    return pin(events, _text=severity.SEVERITY_TEXT, severity=severity.severity_of("_text")).drop("_text")


def format_counts(lines: DataFrame) -> DataFrame:
    """Lines per detected format."""
    return (
        lines.selectExpr(f"coalesce({_DETECTED}, 'none') as format")
        .groupBy("format")
        .agg(F.count("*").alias("n"))
    )
