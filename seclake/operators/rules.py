"""Data-defined detection rules, evaluated in one scan."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.network import starts_with_any
from ..functions.pin import pin
from ..functions.text import EVENT_TEXT, first_case, is_plain, q
from ..schema import RULE
from ..session import literal_table, materialize
from . import ruleindex
from .bursts import SOURCE, count_per_second, trailing_counts


@dataclass(frozen=True)
class Rule:
    """One rule; rules are configuration and live on the driver."""

    id: str
    name: str = "Custom Rule"
    description: str = ""
    severity: str = "medium"
    condition: str = ""
    patterns: tuple[str, ...] = field(default_factory=tuple)
    threshold: int = 1
    time_window: int = 0
    mitre_tactic: str = ""
    mitre_technique: str = ""
    enabled: bool = True

    @property
    def rank(self) -> int:
        # Levels outside the first four sort last.
        return {"critical": 0, "high": 1, "medium": 2, "low": 3}.get(self.severity, 4)


def builtin_rules() -> list[Rule]:
    names = ("id", "name", "description", "severity", "condition", "patterns", "threshold",
             "time_window", "mitre_tactic", "mitre_technique")
    rows = [dict(zip(names, row, strict=True)) for row in fixed.BUILTIN_RULES]
    return [Rule(**{**row, "patterns": tuple(row["patterns"])}) for row in rows]


def merge_rules(base: Iterable[Rule], extra: Iterable[dict]) -> list[Rule]:
    """Append rule records whose id is new; of equal ids the first one counts.

    A record without an id is numbered by the rules present so far.
    """
    merged = list(base)
    known = {rule.id for rule in merged}
    for record in extra:
        given = {k: v for k, v in record.items() if k in Rule.__dataclass_fields__}
        given.setdefault("id", f"R{len(merged):03d}")
        given["patterns"] = tuple(given.get("patterns") or ())
        rule = Rule(**given)
        if rule.id not in known:
            merged.append(rule)
            known.add(rule.id)
    return merged


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [{**asdict(rule), "patterns": list(rule.patterns)} for rule in rules]
    return spark.createDataFrame(rows, RULE)


def quoted(pattern: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", pattern)


_REPEAT = re.compile(r"\{(\d*)(,?)(\d*)\}")
_FLAGS = re.compile(r"\(\?([aiLmsux]+)(-[imsx]+)?([:)])")


def to_java(pattern: str) -> str:
    """A pattern of a rule file (Python's dialect) for the engine which runs it.

    A pattern which is not valid in its own dialect matches its own text.  A valid one
    is never taken literally: what the engine cannot express ends the job.
    """
    try:
        re.compile(pattern, re.IGNORECASE)
    except re.error:
        return quoted(pattern)
    names: dict[str, str] = {}  # Java's group names have no underscore
    out, i, first = [], 0, None  # ``first``: place of the first character of an open class
    while i < len(pattern):
        c, step = pattern[i], 1
        if c == "\\":
            c, step = pattern[i : i + 2], 2
            if first is not None:
                c = {"\\b": "\\x08", "\\v": "\\x0B"}.get(c, c)
            else:
                c = {"\\Z": "\\z", "\\v": "\\x0B"}.get(c, c)
        elif first is not None:
            if c == "]" and i > first:
                first = None
            elif c in "[]&":
                c = "\\" + c
        elif c == "[":
            c = "[^" if pattern.startswith("[^", i) else "["
            step = len(c)
            first = i + step
        elif pattern.startswith("(?P<", i):
            end = pattern.index(">", i)
            name = names.setdefault(pattern[i + 4 : end], f"g{len(names) + 1}")
            c, step = f"(?<{name}>", end + 1 - i
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            c, step = f"\\k<{names[pattern[i + 4 : end]]}>", end + 1 - i
        elif pattern.startswith("(?#", i):
            c, step = "", pattern.index(")", i) + 1 - i
        elif pattern.startswith("(?(", i):
            raise ValueError(f"conditional groups are not supported: {pattern!r}")
        elif found := _FLAGS.match(pattern, i):
            kept = re.sub("[aLu]", "", found[1]) + (found[2] or "")
            c, step = f"(?{kept}{found[3]}" if kept or found[3] == ":" else "", len(found[0])
        elif c == "{":
            found = _REPEAT.match(pattern, i)
            if found and found[0] != "{}":
                c, step = f"{{{found[1] or 0}{found[2]}{found[3]}}}", len(found[0])
            else:
                c = "\\{"
        out.append(c)
        i += step
    return "".join(out)


#: Matching as in rule files: case and classes of all of Unicode, only a line feed ends a line.
MATCH_FLAGS = "(?iuUd)"
#: From so many rules with patterns on, lines look rules up instead of being tested against each.
INDEX_FROM = 50


def _tests(rule: Rule) -> list[tuple[str, bool]]:
    """(pattern, whether it is plain text) of a rule, for the engine which runs it."""
    return [(p.lower(), True) if is_plain(p) else (MATCH_FLAGS + to_java(p), False) for p in rule.patterns]


def _predicate(rule: Rule) -> str:
    """Match condition over the pinned columns ``_low`` (text), ``_type`` and ``source_ip``."""
    if rule.condition == "source_ip_starts_with":
        return starts_with_any("source_ip", fixed.SUSPICIOUS_PREFIXES)
    if rule.condition == "ip_is_tor":
        return starts_with_any("source_ip", (fixed.TOR_PREFIX,))
    # Plain ones first.  One test per pattern: joined by "|", their group names and numbers would collide.
    tests = [f"{'contains' if plain else 'rlike'}({c}, {q(p)})"
             for p, plain in sorted(_tests(rule), key=lambda t: not t[1]) for c in ("_low", "_type")]
    return " or ".join(tests) or "false"


def rule_hits(events: DataFrame, rules: list[Rule], keep: tuple[str, ...] = (), index: bool | None = None) -> DataFrame:
    """One row per (enabled rule, matching event): ``position`` of the rule, ``seq``, ``keep``.

    ``index`` says whether lines look rules up (see ``ruleindex``); None leaves it to the number of rules.  Rules
    with a condition, and those with a pattern that requires no text, are tested on each line in any case.
    """
    text = pin(events, _low=f"lower({EVENT_TEXT})", _type="lower(coalesce(event_type, ''))")
    enabled = [(i, rule) for i, rule in enumerate(rules) if rule.enabled]
    by_pattern = [(i, r) for i, r in enabled if r.patterns and r.condition not in ("source_ip_starts_with", "ip_is_tor")]
    indexed = []
    if index or (index is None and len(by_pattern) >= INDEX_FROM):
        found = iter(ruleindex.keys([p for _, r in by_pattern for p in r.patterns]))
        for i, rule in by_pattern:
            own = [(*test, next(found)) for test in _tests(rule)]
            if all(keys for *_, keys in own):
                indexed.append((i, own))
    looked_up = {i for i, _ in indexed}
    tests = [f"case when {_predicate(rule)} then {i} end" for i, rule in enabled if i not in looked_up]
    parts = []
    if tests or not indexed:
        matched = f"array_compact(array({', '.join(tests) or 'cast(null as int)'}))"
        parts.append(text.selectExpr(f"explode({matched}) as position", "seq", *keep))
    if indexed:
        parts.append(ruleindex.indexed_hits(text, indexed, keep))
    return reduce(DataFrame.unionByName, parts)


def enforce(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """Keep hits only where one source reaches the rule's threshold; returns (position, n).

    With a time window the matches of the window up to the hit count; without one
    all matches of the source do.  Matches without a time count as one window of their
    source.  The hits (``position, source, event_ts``) are
    counted per source and second first, in one scan.
    """
    strict = ", ".join(str(i) for i, r in enumerate(rules) if r.threshold > 1) or "-1"
    timed = hits.selectExpr(
        "position",
        f"if(position in ({strict}), source, '') as source",
        f"if(position in ({strict}), event_ts, null) as event_ts",
    )
    keys = ["position", "source"]
    counted = materialize(count_per_second(timed, keys), "rule-hits")
    parts = [counted.where(f"position not in ({strict})").select("position", "n")]
    for window in sorted({r.time_window for r in rules if r.threshold > 1}):
        wanted = {i: r.threshold for i, r in enumerate(rules)
                  if r.threshold > 1 and r.time_window == window}
        mine = counted.where(f"position in ({', '.join(map(str, wanted))})")
        if window > 0:
            mine = trailing_counts(mine, keys, window)
        else:
            mine = mine.groupBy(*keys).agg(F.sum("n").alias("n")).selectExpr("*", "n as in_window")
        threshold = first_case((f"position = {i}", str(value)) for i, value in wanted.items())
        parts.append(mine.where(f"in_window >= {threshold}").select("position", "n"))
    return reduce(DataFrame.unionByName, parts)


_SAMPLE = ("timestamp", "host", "user", "source_ip", "event_type", "raw_message", "message")


#: Rows of a block in which the first hits of a rule are looked for, as a power of two.
SAMPLE_BITS = 14


def _in_blocks(events: DataFrame, blocks: list[int]) -> DataFrame:
    """Events of some blocks of the order; the limits reach the scan, the rest is dropped before it is parsed."""
    if not blocks:
        return events.where("false")
    listed = ", ".join(f"{b}L" for b in blocks)
    return events.where(
        f"seq >= {blocks[0] << SAMPLE_BITS} and seq < {blocks[-1] + 1 << SAMPLE_BITS} and shiftright(seq, {SAMPLE_BITS}) in ({listed})")


def run_rules(
    events: DataFrame,
    rules: list[Rule] | None = None,
    samples: int = 3,
    thresholds: bool = False,
) -> DataFrame:
    """Rules with at least one match, most severe first.

    ``thresholds=True`` applies each rule's ``threshold`` and ``time_window``; the
    count is then the number of matches at which the threshold was met.  ``samples``
    first matches are attached (0 leaves them out); for a BIGINT ``seq`` they are read from those blocks of the
    order which the first scan found to hold them.
    """
    rules = builtin_rules() if rules is None else rules
    if not rules:
        raise ValueError("no rules given")
    first_blocks = None
    if thresholds:
        hits = rule_hits(events.selectExpr("*", f"{SOURCE} as source"), rules, ("source", "event_ts"))
        counts = enforce(hits, rules).groupBy("position").agg(F.sum("n").alias("count"))
    elif samples and isinstance(events.schema["seq"].dataType, T.LongType):
        # which blocks of the order hold the first hits comes with the counts
        blocks = materialize(
            rule_hits(events, rules).groupBy("position", F.shiftright("seq", SAMPLE_BITS).alias("block")).agg(F.count("*").alias("n")),
            "rule-blocks")
        counts = blocks.groupBy("position").agg(F.sum("n").alias("count"))
        by_block = Window.partitionBy("position").orderBy("block")
        first_blocks = (blocks.withColumn("_n", F.row_number().over(by_block)).where(f"_n <= {samples}")
                        .agg(F.array_sort(F.collect_set("block"))).first()[0])  # ``samples`` of each rule
    else:
        counts = rule_hits(events, rules).groupBy("position").agg(F.count("*").alias("count"))

    table = literal_table(
        events.sparkSession,
        "position, rank, rule_id, rule_name, severity, mitre_tactic, mitre_technique",
        [f"({i}, {r.rank}, {', '.join(q(str(t)) for t in (r.id, r.name, r.severity, r.mitre_tactic, r.mitre_technique))})"
         for i, r in enumerate(rules)],
    )
    result = counts.join(F.broadcast(table), "position")  # rules are driver-side configuration
    if samples:
        order = Window.partitionBy("position").orderBy("seq")
        first = (
            rule_hits(events if first_blocks is None else _in_blocks(events, first_blocks), rules, _SAMPLE)
            .withColumn("_n", F.row_number().over(order))
            .where(f"_n <= {samples}")
            .groupBy("position")
            .agg(F.array_sort(F.collect_list(F.struct("_n", "seq", *_SAMPLE))).alias("_s"))
            .select("position", F.transform("_s", lambda s: s.dropFields("_n")).alias("sample_records"))
        )
        result = result.join(first, "position", "left")
    message = F.format_string("%s: %d matches", "rule_name", "count")
    columns = ["rule_id", "rule_name", "severity", "count", message.alias("message"),
               "mitre_tactic", "mitre_technique"]
    if samples:
        columns.append("sample_records")
    return result.orderBy("rank", "position").select(*columns)


def rule_summary(results: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Totals over the fired rules; ``rules_evaluated`` counts disabled rules too."""
    rules = builtin_rules() if rules is None else rules
    return results.agg(
        F.lit(len(rules)).alias("rules_evaluated"),
        F.count("*").alias("matches"),
        *[F.count_if(F.col("severity") == level).alias(level)
          for level in ("critical", "high", "medium", "low")],
    )
