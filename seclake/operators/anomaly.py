"""Statistical baselines and anomaly checks."""

from __future__ import annotations

import struct
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import times
from ..functions.pin import pin
from ..functions.text import EVENT_TEXT, JOINED_TEXT, has_any, present, q
from ..session import materialize
from .detections import FAILED_LOGIN
from .ordering import order_value_at
from .summary import events_per_minute

METRICS = ("failed_logins", "auth_failures", "unique_ips", "unique_users")
_STATS = ("mean", "std_dev", "min_val", "max_val", "median", "p95", "p99")


def value_bucket(col: str) -> str:
    """Stable bucket 0-999 of a text: first 32 bits of its MD5 modulo 1000."""
    return f"cast(cast(conv(substring(md5({col}), 1, 8), 16, 10) as bigint) % 1000 as double)"


def facts(events: DataFrame) -> DataFrame:
    """What the checks need to know about each event, without its text."""
    low = pin(events, _low=f"lower({EVENT_TEXT})", _joined=f"lower({JOINED_TEXT})")
    return low.selectExpr(
        "seq", "timestamp", "source_ip", "user",
        f"{FAILED_LOGIN} as failed",
        f"{has_any('_low', fixed.AUTH_FAILURE_WORDS)} as denied",
        f"{has_any('_joined', fixed.AUTH_FAILURE_WORDS)} as denied_now",
    )


# metric -> (condition under which an event contributes, its value)
_CONTRIBUTES = {
    "failed_logins": ("failed", "1.0D"),
    "auth_failures": ("denied", "1.0D"),
    "unique_ips": (present("source_ip"), value_bucket("source_ip")),
    "unique_users": (present("user"), value_bucket("user")),
}


def metric_histogram(known: DataFrame, *by: str) -> DataFrame:
    """(``by``, metric, value, n) from facts: at most a thousand values per metric."""
    values = ", ".join(
        f"case when {test} then struct({q(name)} as metric, {value} as value) end"
        for name, (test, value) in _CONTRIBUTES.items()
    )
    return (
        known.selectExpr(*by, f"explode(array_compact(array({values}))) as m")
        .selectExpr(*by, "m.metric", "m.value")
        .groupBy(*by, "metric", "value")
        .agg(F.count("*").alias("n"))
    )


def histogram_stats(histogram: DataFrame, *keys: str) -> DataFrame:
    """Statistics per key from (keys, value, n), value counts being few per key.

    Mean, sample deviation (0 for a single value), range, interpolated median, and
    the values at position floor(count * q) of the sorted list, counted from 0.
    """
    group = Window.partitionBy(*keys)
    running = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        histogram.withColumn("_end", F.sum("n").over(running))
        .withColumn("_total", F.sum("n").over(group))
        .withColumn("_sum", F.sum(F.expr("value * n")).over(group))
        .selectExpr("*", "_sum / _total as _mean")
    )

    def at(position: str) -> str:
        """Value at a 0-based position of the expanded, sorted list."""
        return f"max(value) filter (where {position} < _end and {position} >= _end - n)"

    spread = "sqrt(sum(n * pow(value - _mean, 2)) / (max(_total) - 1))"
    return ranked.groupBy(*keys).agg(
        F.expr("max(_mean) as mean"),
        F.expr(f"case when max(_total) > 1 then {spread} else 0.0D end as std_dev"),
        F.expr("min(value) as min_val"),
        F.expr("max(value) as max_val"),
        F.expr(f"({at('floor((_total - 1) / 2)')} + {at('floor(_total / 2)')}) / 2 as median"),
        F.expr(f"{at('floor(_total * 0.95D)')} as p95"),
        F.expr(f"{at('floor(_total * 0.99D)')} as p99"),
        F.expr("max(_total) as sample_count"),
    )


def baselines(events: DataFrame) -> DataFrame:
    """Statistics of the four standard metrics (metrics without values are absent)."""
    return histogram_stats(metric_histogram(facts(events)), "metric")


def baseline(events: DataFrame, metric: str) -> DataFrame:
    """Statistics of one metric: a standard one, or any numeric field of the events."""
    if metric in METRICS:
        return baselines(events).where(F.col("metric") == metric)
    if metric == "events_per_minute":
        numbers = events_per_minute(events).selectExpr("cast(events as double) as value")
    else:
        numbers = (
            events.where(present(f"cast({metric} as string)"))
            .selectExpr(f"try_cast({metric} as double) as value")
            .where("value is not null")
        )
    # Read several times below.
    values = materialize(numbers.groupBy("value").agg(F.count("*").alias("n")), "values")
    return field_stats(values).selectExpr(f"{q(metric)} as metric", "*")


# Bits of a double, the sign turned so that they are in the order of the values as unsigned numbers.  Infinities
# stand at the ends, NaN above all.
_BITS = "cast(reflect('java.lang.Double', 'doubleToLongBits', value) as bigint)"
_SORTABLE = "if(_bits < 0, ~_bits, _bits ^ (-9223372036854775807L - 1))"
_DIGIT_BITS = 16


def _value_of(key: int) -> float:
    bits = key ^ 1 << 63 if key >> 63 else ~key & (1 << 64) - 1
    return struct.unpack(">d", bits.to_bytes(8, "big"))[0]


def values_at(values: DataFrame, positions: set[int]) -> dict[int, float]:
    """Values at 0-based positions of the sorted list which (value, n) describes.

    Radix selection: each of four steps counts the next sixteen bits of the values which share the bits found so
    far, for all positions in one pass, so nothing is sorted but 65,536 counts for each position.
    """
    keyed = materialize(values.selectExpr("n", f"{_BITS} as _bits").selectExpr("n", f"{_SORTABLE} as _key"), "sortable")
    found = {p: (0, p) for p in positions}  # bits so far, position among the values which have them
    for used in range(0, 64, _DIGIT_BITS):
        prefixes = sorted({prefix for prefix, _ in found.values()})
        prefix = f"shiftrightunsigned(_key, {64 - used})" if used else "0L"
        digit = f"shiftrightunsigned(_key, {64 - used - _DIGIT_BITS}) & {(1 << _DIGIT_BITS) - 1}L"
        counts = (
            keyed.selectExpr(f"{prefix} as _prefix", f"{digit} as _digit", "n")
            .where(f"_prefix in ({', '.join(f'{x}L' for x in prefixes)})")
            .groupBy("_prefix", "_digit")
            .agg(F.sum("n").alias("m"))
        )
        running = Window.partitionBy("_prefix").orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        wanted = " or ".join(f"(_prefix = {x}L and _end > {at}L and _end - m <= {at}L)" for x, at in set(found.values()))
        hits = counts.withColumn("_end", F.sum("m").over(running)).where(wanted).collect()  # one row per position at most
        step = {}
        for p, (x, at) in found.items():
            hit = next(h for h in hits if h["_prefix"] == x and h["_end"] - h["m"] <= at < h["_end"])
            step[p] = (x << _DIGIT_BITS | hit["_digit"], at - hit["_end"] + hit["m"])
        found = step
    return {p: _value_of(key) for p, (key, _) in found.items()}


def field_stats(values: DataFrame) -> DataFrame:
    """One row of statistics from a stored table (value, n) of distinct values.

    Infinities and NaN are in order with the others; mean and deviation are what sums with them give.
    """
    count, mean = values.selectExpr("sum(n)", "sum(value * n) / sum(n)").first()
    if not count:
        return values.selectExpr(*[f"value as {c}" for c in _STATS], "n as sample_count").limit(0)
    lo, hi, p95, p99 = (count - 1) // 2, count // 2, int(count * 0.95), int(count * 0.99)
    at = values_at(values, {lo, hi, p95, p99})
    deviation = F.sqrt(F.sum(F.col("n") * F.pow(F.col("value") - F.lit(mean), 2)) / F.lit(max(count - 1, 1)))
    return values.agg(
        F.lit(mean).alias("mean"),
        deviation.alias("std_dev"),
        F.min("value").alias("min_val"),
        F.max("value").alias("max_val"),
        F.lit((at[lo] + at[hi]) / 2).alias("median"),
        F.lit(at[p95]).alias("p95"),
        F.lit(at[p99]).alias("p99"),
        F.lit(count).cast("bigint").alias("sample_count"),
    )


def _anomaly(
    metric: str, value: str, low: str, high: str, mean: str, z: str, severity: str, description: str
) -> list[str]:
    return [
        f"{metric} as metric",
        f"cast({value} as double) as value",
        f"struct(cast({low} as double) as low, cast({high} as double) as high) as expected_range",
        f"cast({value} - {mean} as double) as deviation",
        f"cast({z} as double) as z_score",
        f"{severity} as severity",
        f"{description} as description",
    ]


def _baseline_for(known: DataFrame, baseline_events: DataFrame | None) -> DataFrame:
    """The statistics current facts are compared with.

    From ``baseline_events`` when there are any, else from the first half of the events
    (all of them when there are ten or fewer).  Metrics without a value there are taken
    from the events themselves.
    """
    if baseline_events is None or baseline_events.isEmpty():
        cut = order_value_at(known, "case when n > 10 then floor(n / 2) else n end")
        # One scan serves both: the histogram is kept per half.
        marked = known.withColumn("_base", F.col("seq") <= cut.scalar())
        histogram = materialize(metric_histogram(marked, "_base"), "histogram")
        own = histogram.where("_base").select("metric", "value", "n")
        whole = histogram.groupBy("metric", "value").agg(F.sum("n").alias("n"))
    else:
        own = materialize(metric_histogram(facts(baseline_events)), "histogram")
        whole = materialize(metric_histogram(known), "histogram")
    first = histogram_stats(own, "metric")
    rest = histogram_stats(whole, "metric").join(first.select("metric"), "metric", "left_anti")
    return first.unionByName(rest)


def _current_values(known: DataFrame) -> DataFrame:
    """(metric, current): the counts which are checked against the baselines."""
    row = known.selectExpr(
        "count_if(failed) as failed_logins",
        "count_if(denied_now) as auth_failures",
        "count(distinct nullif(source_ip, '')) as unique_ips",
    )
    return row.unpivot([], ["failed_logins", "auth_failures", "unique_ips"], "metric", "current")


def metric_anomalies(
    events: DataFrame, baseline_events: DataFrame | None = None, sensitivity: float = 2.0
) -> DataFrame:
    """Counts far from their baseline.

    Without spread in the baseline a value above twice the mean is an anomaly of
    level high with z 999; else the z score decides.
    """
    return _metric_anomalies(materialize(facts(events), "facts"), baseline_events, sensitivity)


def _metric_anomalies(
    known: DataFrame, baseline_events: DataFrame | None, sensitivity: float
) -> DataFrame:
    s = f"{float(sensitivity)}D"
    compared = (
        _current_values(known)
        .join(_baseline_for(known, baseline_events), "metric")
        .selectExpr("*", "std_dev = 0 as flat",
                    "if(std_dev = 0, 999.0D, try_divide(current - mean, std_dev)) as z")
    )
    return compared.where(f"if(flat, current > mean * 2, abs(z) > {s})").selectExpr(
        *_anomaly(
            "metric", "current",
            f"if(flat, 0.0D, mean - std_dev * {s})",
            f"if(flat, mean * 2, mean + std_dev * {s})",
            "mean", "z",
            "case when flat then 'high' when abs(z) > 4 then 'critical' when abs(z) > 3 then 'high' else 'medium' end",
            "if(flat, format_string('Value %d is significantly higher than baseline mean %.1f', current, mean), "
            "format_string('Value %.1f is %.1f std devs from baseline', cast(current as double), abs(z)))",
        )
    )


def off_hours(events: DataFrame) -> DataFrame:
    """Hours before 6 or after 22 with more than 1.5 times the mean hourly count."""
    hours = (
        events.selectExpr(f"{times.hour_before_colon('timestamp')} as hour")
        .where("hour is not null")
        .groupBy("hour")
        .agg(F.count("*").alias("n"))
    )
    return (
        # one row per hour
        hours.selectExpr("hour", "n", "avg(n) over () as mean", "coalesce(stddev_samp(n) over (), 0) as std")
        .where("(hour < 6 or hour > 22) and n > mean * 1.5")
        .selectExpr(
            *_anomaly(
                "'off_hours_activity'", "n", "0", "mean * 1.5", "mean",
                "coalesce(try_divide(n - mean, std), 0)", "'medium'",
                "format_string('Unusual activity at %d:00 (off hours)', hour)",
            )
        )
    )


def single_source_flood(events: DataFrame) -> DataFrame:
    """The busiest source when it has more than five times the mean count per source."""
    per_ip = (
        events.where(present("source_ip"))
        .groupBy("source_ip")
        .agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    )
    return (
        per_ip.selectExpr(
            "min_by(source_ip, struct(-n, first)) as ip", "max(n) as n", "avg(n) as mean"
        )
        .where("n > mean * 5")
        .selectExpr(
            *_anomaly(
                "'single_source_flood'", "n", "0", "mean * 5", "mean", "999", "'high'",
                "format_string('IP %s responsible for %d events (avg: %.1f)', ip, n, mean)",
            )
        )
    )


def detect_anomalies(
    events: DataFrame, baseline_events: DataFrame | None = None, sensitivity: float = 2.0
) -> DataFrame:
    """All anomalies.  The events are read once, into a narrow table of facts."""
    known = materialize(facts(events), "facts")
    return reduce(
        DataFrame.unionByName,
        [
            _metric_anomalies(known, baseline_events, sensitivity),
            off_hours(known),
            single_source_flood(known),
        ],
    )


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    return anomalies.selectExpr(
        "count(*) as total_anomalies",
        *[f"count_if(severity = {q(level)}) as {level}" for level in ("critical", "high", "medium", "low")],
        "array_sort(collect_set(metric)) as metrics_affected",
    )


def minute_rate_anomalies(events: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    """Minutes whose event count is more than ``sensitivity`` deviations from the mean."""
    counts = events_per_minute(events)
    stats = counts.selectExpr("struct(avg(events) as mean, stddev_samp(events) as std) as s")
    return (
        counts.withColumn("s", stats.scalar())
        .selectExpr("minute", "events", "try_divide(events - s.mean, s.std) as z_score")
        .where(f"abs(z_score) > {float(sensitivity)}D")
        .selectExpr(f"{times.clock('minute')} as minute", "events", "z_score")
    )


def minute_rate_anomalies_dense(events: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    """Like ``minute_rate_anomalies``, minutes without events between the first and the last one counting as zeros.

    The silent minutes enter mean and spread by their number, which the span gives; no rows are made for them, and
    they are not listed.
    """
    counts = events_per_minute(events)
    sums = counts.selectExpr(
        "cast((unix_timestamp(max(minute)) - unix_timestamp(min(minute))) / 60 + 1 as bigint) as m",
        "sum(events) as total", "sum(cast(events as double) * events) as squares")
    stats = sums.selectExpr("m", "total / m as mean", "squares").selectExpr(
        "struct(mean, sqrt(try_divide(greatest(squares - m * mean * mean, 0), m - 1)) as std) as s")
    return (
        counts.withColumn("s", stats.scalar())
        .selectExpr("minute", "events", "try_divide(events - s.mean, s.std) as z_score")
        .where(f"abs(z_score) > {float(sensitivity)}D")
        .selectExpr(f"{times.clock('minute')} as minute", "events", "z_score")
    )
