"""Streaming forms of the jobs.

Input is any streaming DataFrame of lines (``sources.lines.stream_lines``,
``message_lines`` over a socket or Kafka source, or an own one with a ``line``
column); output is a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import times
from ..operators.bursts import SOURCE
from ..operators.detections import failed_logins
from ..operators.ordering import count_ahead
from ..operators.parse import parse_lines, score
from ..session import materialize, scratch_path
from ..sinks.alerts import to_alerts


def stream_events(
    lines: DataFrame, year: int | str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Parsed and scored events; lines without an event are left out."""
    return score(parse_lines(lines, year, keep=keep))


def stream_alerts(
    lines: DataFrame, threshold: str = "medium", year: int | str | None = None
) -> DataFrame:
    return to_alerts(stream_events(lines, year), threshold)


def dedupe_replays(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Drop re-read rows which arrive within the delay of their first copy."""
    return events.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_bursts(
    events: DataFrame,
    threshold: int = 5,
    minutes: int = 10,
    slide_minutes: int = 1,
    delay: str = "10 minutes",
) -> DataFrame:
    """Sources with ``threshold`` failed logins in a sliding window of event time.

    Counts are combined before the shuffle, so a busy source costs one row per
    window and task.
    """
    failed = failed_logins(events).selectExpr("event_ts", f"{SOURCE} as source")
    windows = F.window("event_ts", f"{minutes} minutes", f"{slide_minutes} minutes")
    return (
        failed.withWatermark("event_ts", delay)
        .where("source <> ''")
        .groupBy(windows.alias("w"), "source")
        .agg(F.count("*").alias("attempts"))
        .where(f"attempts >= {threshold}")
        .selectExpr("source", f"{times.clock('w.start')} as started_at",
                    f"{times.clock('w.end')} as ended_at", "attempts")
    )


def stream_sessions(
    events: DataFrame, gap_minutes: int = 10, delay: str = "10 minutes"
) -> DataFrame:
    """Runs of failed logins per source, ended by a pause."""
    failed = failed_logins(events).selectExpr("event_ts", f"{SOURCE} as source")
    session = F.session_window("event_ts", f"{gap_minutes} minutes")
    return (
        failed.withWatermark("event_ts", delay)
        .where("source <> ''")
        .groupBy(session.alias("w"), "source")
        .agg(F.count("*").alias("attempts"))
        .selectExpr("source", f"{times.clock('w.start')} as started_at",
                    f"{times.clock('w.end')} as ended_at", "attempts")
    )


def micro_batches(
    rows: DataFrame,
    callback: Callable[[DataFrame, int], None],
    checkpoint: str,
    seconds: float = 5.0,
) -> StreamingQuery:
    """Hand each micro-batch to ``callback(batch, batch_id)`` every few seconds."""
    return (
        rows.writeStream.foreachBatch(callback)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
        .start()
    )


def append_to_table(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the rows of a stream to a parquet table, each exactly once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def catch_up(rows: DataFrame, name: str) -> DataFrame:
    """Process everything available now and return the table written.

    Windows and sessions which the watermark has not passed stay open; see ``catch_up_closed``.
    """
    spark = rows.sparkSession
    base = scratch_path(spark, name)
    append_to_table(rows, f"{base}/table", f"{base}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/table")


# A failed login after all others.  It takes part in every job on failed logins.
_LAST = {"event_ts": "timestamp'9999-01-01 00:00:00'", "event_type": "'fail'", "user": "'-'"}


def catch_up_closed(events: DataFrame, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The table ``job`` writes from a stream of events which has ended: nothing stays open.

    When everything available is processed, an event far in the future moves the
    watermark past all open windows and sessions.  Its own stays open and never comes out.
    """
    spark = events.sparkSession
    base = scratch_path(spark, name)
    last = spark.range(1).select(*[
        F.expr(_LAST.get(field.name, "null")).cast(field.dataType).alias(field.name)
        for field in events.schema
    ])
    last.where("false").write.parquet(f"{base}/end")
    rows = job(events.unionByName(spark.readStream.schema(last.schema).parquet(f"{base}/end")))
    for step in ("input", "end"):
        if step == "end":
            last.write.mode("append").parquet(f"{base}/end")
        append_to_table(rows, f"{base}/table", f"{base}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/table")


class _Slots:
    """The state of a ``foreachBatch`` callback: one row a batch, the two newest kept.

    A batch reads the newest state before its own number and writes over the other one, so the state it started
    from is still there if it fails and is repeated.  Numbers may start anywhere or be left out.
    """

    def __init__(self, path: str, state: T.StructType):
        self.paths = [f"{path}/slot={i}" for i in range(2)]
        self.state = state
        self.schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("state", state)])

    def _read(self, spark, path: str) -> DataFrame:
        try:
            return spark.read.schema(self.schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.schema)

    def _newest(self, spark, below: int) -> tuple[int | None, DataFrame | None]:
        best, found, number = None, None, -1
        for i, path in enumerate(self.paths):
            rows = self._read(spark, path)
            first = rows.select("batch").first()
            if first and number < first[0] < below:
                best, found, number = i, rows, first[0]
        return best, found

    def before(self, spark, batch_id: int) -> DataFrame:
        """At most one row: the newest state of a smaller number, its fields as columns."""
        found = self._newest(spark, batch_id)[1]
        return (self._read(spark, self.paths[0]).where("false") if found is None else found).select("state.*")

    def write(self, state: DataFrame, batch_id: int) -> None:
        """``state``: one row, which may depend on the state before."""
        slot = self._newest(state.sparkSession, batch_id)[0]
        fields = F.struct(*self.state.names).cast(self.state)
        state.select(F.lit(batch_id).cast("bigint").alias("batch"), fields.alias("state")).coalesce(1).write.mode(
            "overwrite").parquet(self.paths[1 if slot == 0 else 0])


def _nullable(schema: T.StructType) -> T.StructType:
    """Kept rows come back from a table, in which any column may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


class RecentAlerts:
    """Keeps the last ``keep`` alerts of a stream as a small table.

    Used as a ``foreachBatch`` callback.  Newest are the latest by ``order`` (alerts without one come last), of
    equal ones those which arrived later.  Two lists exist at any time, see ``_Slots``.
    """

    def __init__(self, path: str, keep: int = 50, order: str = "event_ts"):
        self.path, self.keep, self.order = path, keep, order

    def _slots(self, schema: T.StructType) -> _Slots:
        alert = T.StructType([*_nullable(schema).fields, T.StructField("_arrived", T.LongType())])
        return _Slots(self.path, T.StructType([T.StructField("alerts", T.ArrayType(alert))]))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        slots = self._slots(batch.schema)
        before = slots.before(batch.sparkSession, batch_id).selectExpr("inline(alerts)")
        rows = batch.withColumn("_arrived", F.lit(batch_id).cast("bigint")).unionByName(before)
        ties = [F.desc("seq")] if "seq" in batch.columns else []
        newest = rows.orderBy(F.desc_nulls_last(self.order), F.desc("_arrived"), *ties).limit(self.keep)
        slots.write(newest.agg(F.collect_list(F.struct(*rows.columns)).alias("alerts")), batch_id)

    def read(self, spark, batch_id: int, schema: T.StructType) -> DataFrame:
        """The newest list not above this batch; only the last two are kept."""
        return self._slots(schema).before(spark, batch_id + 1).selectExpr("inline(alerts)").select(*schema.names)


class RowGroups:
    """Hands rows of a stream on in groups of ``size``, which cross micro-batches.

    Used as a ``foreachBatch`` callback.  Rows are numbered in the order of a BIGINT column; those which fill
    no group wait for the next batch, and ``flush`` releases them when the stream has ended.  ``callback(groups,
    batch_id)`` gets whole groups, with the columns ``group_id`` and ``position``; without one they are appended to
    the table ``groups`` below ``path``, where a repeated batch replaces its own rows.
    """

    def __init__(self, path: str, size: int = 10, order: str = "seq", callback: Callable[[DataFrame, int], None] | None = None):
        self.path, self.size, self.order = path, size, order
        self.callback = callback or self._append

    def _append(self, groups: DataFrame, batch_id: int) -> None:
        groups.write.mode("overwrite").parquet(f"{self.path}/groups/batch={batch_id}")

    def _slots(self, schema: T.StructType) -> _Slots:
        return _Slots(f"{self.path}/rest", T.StructType([
            T.StructField("next_group", T.LongType()), T.StructField("rest", T.ArrayType(_nullable(schema)))]))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        slots = self._slots(batch.schema)
        state = slots.before(spark, batch_id).first()  # fewer rows than a group
        done, held = (state.next_group, len(state.rest)) if state else (0, 0)
        rest = slots.before(spark, batch_id).selectExpr("posexplode(rest) as (_place, _row)").selectExpr("_row.*", "cast(_place as bigint) as _place")
        batch = materialize(batch, "batch")  # counted and numbered
        numbered = count_ahead(batch, [], "_place", self.order, later=False).withColumn("_place", F.col("_place") + held)
        rows = numbered.select(*columns, "_place").unionByName(rest.select(*columns, "_place"))
        whole = (held + batch.count()) // self.size
        place = [(F.floor(F.col("_place") / self.size) + done).alias("group_id"), (F.col("_place") % self.size).alias("position")]
        self.callback(rows.where(F.col("_place") < whole * self.size).select(*columns, *place), batch_id)
        left = rows.where(F.col("_place") >= whole * self.size).select("_place", F.struct(*columns).alias("_row"))
        slots.write(left.agg(F.array_sort(F.collect_list(F.struct("_place", "_row"))).alias("r")).select(
            F.lit(done + whole).alias("next_group"), F.col("r._row").alias("rest")), batch_id)

    def flush(self, spark, schema: T.StructType, batch_id: int) -> None:
        """Release what is left as a last, shorter group, under a number above all others."""
        last = self._slots(schema).before(spark, batch_id).selectExpr("next_group as group_id", "posexplode(rest) as (position, _row)")
        self.callback(last.selectExpr("_row.*", "group_id", "cast(position as bigint) as position"), batch_id)

    def read(self, spark, schema: T.StructType) -> DataFrame:
        """The table of groups."""
        own = T.StructType([*_nullable(schema).fields, T.StructField("group_id", T.LongType()), T.StructField("position", T.LongType())])
        return spark.read.schema(own).parquet(f"{self.path}/groups").select(*own.names)


def run_batches(rows: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand everything available now to a ``foreachBatch`` callback, going on behind the checkpoint."""
    (rows.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
