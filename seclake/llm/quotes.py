"""Quotation linking of messages, in DataFrame operations only.

A line's quote level is the number of ``>`` before it.  Adjacent lines of one level without a blank line
between are a passage; its hash is taken over the text without marks, with white space collapsed and in
lower case.  A quoted passage is linked to its original: the latest message of the scope before the quoting one
which has it as text of its own.  A message answers the original that it quotes at the
lowest level, of several the latest.  Answers of answers make a conversation, whose messages follow what they
answer; their texts are given without quotes and without the lines which introduce them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize

_MARKS = r"^((?:[ \\t]?>)+)"
_SPACE = r"[ \\t\\n\\f\\r]+"
#: Lower-cased lines such as "on monday, ann wrote:" which introduce a quote.
_INTRODUCES = r"^on .*wrote:$"
#: Orders in a row which may be one run of answers.
RUN = 4096
#: Orders of a block in which the latest original is looked for by a window.
BLOCK = 1 << 20


def parse(messages: DataFrame, text: str) -> DataFrame:
    """Add body (text without quotes) and passages (level and hash of each)."""
    # each step stands behind a one-element explode, so that it is computed once and not inside later loops
    lines = messages.withColumn("__lines", F.expr(
        f"explode(array(transform(split(coalesce({text}, ''), '\\r?\\n'), x -> named_struct('raw', x, "
        f"'level', length(regexp_replace(regexp_extract(x, '{_MARKS}', 1), '[^>]', '')), "
        f"'plain', lower(trim(regexp_replace(regexp_replace(x, '{_MARKS}', ''), '{_SPACE}', ' ')))))))"))
    lines = lines.withColumn("__lines", F.expr(
        f"explode(array(filter(__lines, x -> not (x.level = 0 and x.plain rlike '{_INTRODUCES}'))))"))
    starts = lines.withColumn("__starts", F.expr(
        "explode(array(filter(transform(__lines, (x, i) -> if(x.plain <> '' and (i = 0 or __lines[i - 1].plain = '' "
        "or __lines[i - 1].level <> x.level), i, -1)), i -> i >= 0)))"))
    passages = starts.withColumn("passages", F.expr(
        "transform(__starts, (s, k) -> named_struct('level', __lines[s].level, 'hash', md5(array_join(filter(transform("
        "slice(__lines, s + 1, if(k + 1 < size(__starts), __starts[k + 1], size(__lines)) - s), x -> x.plain), "
        "x -> x <> ''), ' '))))"))
    return passages.withColumn("body", F.expr(
        "trim(both '\\n' from array_join(transform(filter(__lines, x -> x.level = 0), x -> x.raw), '\\n'))")).drop("__lines", "__starts")


def latest_before(passages: DataFrame) -> DataFrame:
    """(scope, at, level, origin) of quoted passages: the latest order below ``at`` with the same passage at level 0.

    Found in blocks of orders: within a block by a window, across blocks by the greatest order of each block before.
    So a passage which very many messages share is no group of its own.
    """
    marks = passages.select("scope", "hash", F.floor(F.col("at") / BLOCK).alias("block"), "at", "level",
                            F.when(F.col("level") == 0, F.col("at")).alias("own"))
    inside = Window.partitionBy("scope", "hash", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("scope", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marks.groupBy("scope", "hash", "block").agg(F.max("own").alias("last")).withColumn("before", F.max("last").over(earlier))
    blocks = blocks.where("before is not null").select(F.col("scope").alias("s"), F.col("hash").alias("h"), F.col("block").alias("b"), "before")
    quoted = marks.withColumn("near", F.max("own").over(inside)).where("level > 0")
    return quoted.join(blocks, quoted.scope.eqNullSafe(F.col("s")) & (quoted.hash == F.col("h")) & (quoted.block == F.col("b")), "left").select(
        "scope", "at", "level", F.coalesce("near", "before").alias("origin"))


def link_quotes(messages: DataFrame, order: str, scope: str | None = None, text: str = "text") -> DataFrame:
    """Link messages by the passages they quote.

    ``order`` names the column by which messages follow one another (an integer; unique within ``scope``), ``scope``
    the column within which originals are looked for (a mailing list, a mailbox; all messages if None).

    Returns the columns of ``messages`` and parent (order of the message answered, null for none), root (order of
    the first message of the conversation), depth (answers from there), n_quoted (quoted passages), n_linked (those
    with an original), body (text without quotes).  In order of (scope, root, order) each message follows
    what it answers.  Input columns with these names are replaced.

    Null and empty texts have no passages and an empty body.  A message without an order quotes and answers
    nothing and is nobody's original; its root is null.  Messages with the same scope and order, repeated rows too,
    are parts of one message.  A null scope is a scope of its own.  An empty table gives an empty result.
    """
    new = ["parent", "root", "depth", "n_quoted", "n_linked", "body"]
    inside = F.col(scope) if scope else F.lit(0)
    rows = parse(messages.drop(*new, "passages"), text)
    # inline, not explode with field access, for which the optimizer would repeat the parsing inside its loops
    keyed = materialize(rows.select(inside.alias("scope"), F.col(order).alias("at"), F.inline("passages")).where(
        "at is not null").select("scope", "at", "level", "hash"), "passages")
    quoted = latest_before(keyed)
    answers = materialize(quoted.groupBy("scope", "at").agg(
        F.min(F.when(F.col("origin").isNotNull(), F.struct("level", (-F.col("origin")).alias("back")))).alias("best"),
        F.count("*").alias("n_quoted"), F.count("origin").alias("n_linked")).select(
        "scope", "at", (-F.col("best.back")).alias("parent"), "n_quoted", "n_linked"), "answers")

    # messages which answer the one just before are a run, of at most RUN orders; only its head is followed back
    before = Window.partitionBy("scope", F.floor(F.col("at") / RUN)).orderBy("at")
    runs = answers.where("parent is not null").withColumn("last", F.lag("at").over(before)).withColumn(
        "head", F.when((F.col("parent") == F.col("at") - 1) & (F.col("parent") == F.col("last")), None).otherwise(F.col("at")))
    runs = materialize(runs.select("scope", "at", "parent", F.max("head").over(before).alias("head")), "runs")
    heads = runs.where("at = head").select("scope", "at", "parent").alias("h").join(
        runs.select("scope", "at", "head").alias("t"),
        F.col("h.scope").eqNullSafe(F.col("t.scope")) & (F.col("h.parent") == F.col("t.at")), "left")
    seen = materialize(heads.select(
        "h.scope", "h.at", F.coalesce("t.head", "h.parent").alias("root"),
        (F.lit(1) + F.coalesce(F.col("t.at") - F.col("t.head"), F.lit(0))).cast("bigint").alias("depth"),
        F.col("t.head").isNotNull().alias("moves")), "roots")
    # each step doubles how far back a head sees, until its root answers nothing
    while seen.where("moves").head(1):
        far = seen.select(F.col("scope").alias("s"), F.col("at").alias("a"), F.col("root").alias("r"), F.col("depth").alias("d"),
                          F.col("moves").alias("m"))
        near = seen.where("moves")
        stepped = near.join(far, near.scope.eqNullSafe(far.s) & (near.root == far.a)).select(
            "scope", "at", F.col("r").alias("root"), (F.col("depth") + F.col("d")).alias("depth"), F.col("m").alias("moves"))
        seen = materialize(seen.where("not moves").unionByName(stepped), "roots")
    ends = runs.alias("n").join(
        seen.alias("h"), F.col("n.scope").eqNullSafe(F.col("h.scope")) & (F.col("n.head") == F.col("h.at"))).select(
        F.col("n.scope").alias("s"), F.col("n.at").alias("a"), "h.root", (F.col("h.depth") + F.col("n.at") - F.col("n.head")).alias("depth"))
    known = answers.join(ends, answers.scope.eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")), "left").select(
        F.col("scope").alias("__scope"), F.col("at").alias("__at"), *new[:3], "n_quoted", "n_linked")
    joined = rows.withColumn("__in", inside).join(
        known, F.col("__in").eqNullSafe(F.col("__scope")) & (F.col(order) == F.col("__at")), "left")
    return joined.withColumns({
        "root": F.coalesce("root", F.col(order)), "depth": F.coalesce("depth", F.lit(0)),
        "n_quoted": F.coalesce("n_quoted", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0))}).drop(
        "__in", "__scope", "__at", "passages")


def as_mail(conversations: DataFrame) -> DataFrame:
    """The turns of conversations as mail: each quotes the turn before and, one level deeper, the one before that."""
    turn = conversations.select("conv_id", "turn", "role", "text")
    one = turn.select(F.col("conv_id").alias("c1"), (F.col("turn") + 1).alias("t1"), F.col("text").alias("x1"))
    two = turn.select(F.col("conv_id").alias("c2"), (F.col("turn") + 2).alias("t2"), F.col("text").alias("x2"))
    both = turn.join(one, (F.col("conv_id") == F.col("c1")) & (F.col("turn") == F.col("t1")), "left").join(
        two, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left")
    return both.select("conv_id", "turn", "role", F.expr(
        "concat_ws('\\n', '>> ' || replace(x2, '\\n', '\\n>> '), if(x1 is null, null, 'On ' || (turn - 1) || ' they wrote:'), "
        "'> ' || replace(x1, '\\n', '\\n> '), text)").alias("text"))


def op6_quotes(spark, sf_dir: str) -> DataFrame:
    mail = as_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link_quotes(mail, "turn", "conv_id").select(
        "conv_id", "turn", "role", "parent", "root", "depth", "n_quoted", "n_linked", "body")


SQL = r"""
with recursive mail as (
  select c.conv_id, c.turn, c.role, concat_ws(chr(10), '>> ' || replace(b.text, chr(10), chr(10) || '>> '),
    case when a.text is not null then 'On ' || (c.turn - 1) || ' they wrote:' end,
    '> ' || replace(a.text, chr(10), chr(10) || '> '), c.text) as text
  from conversations c left join conversations a on a.conv_id = c.conv_id and a.turn + 1 = c.turn
  left join conversations b on b.conv_id = c.conv_id and b.turn + 2 = c.turn),
l0 as (
  select conv_id, turn, unnest(string_split_regex(text, '\r?\n')) as raw, generate_subscripts(string_split_regex(text, '\r?\n'), 1) as n from mail),
l1 as (
  select *, len(regexp_replace(regexp_extract(raw, '^((?:[ \t]?>)+)', 1), '[^>]', '', 'g')) as level,
    lower(trim(regexp_replace(regexp_replace(raw, '^((?:[ \t]?>)+)', ''), '[ \t\n\f\r]+', ' ', 'g'))) as plain from l0),
l2 as (select * from l1 where not (level = 0 and regexp_matches(plain, '^on .*wrote:$'))),
l3 as (
  select *, plain <> '' and (lag(plain) over w is null or lag(plain) over w = '' or lag(level) over w <> level) as starts
  from l2 window w as (partition by conv_id, turn order by n)),
l4 as (select *, sum(starts::int) over (partition by conv_id, turn order by n) as passage from l3),
p as (
  select conv_id, turn, passage, any_value(level) as level, md5(string_agg(plain, ' ' order by n)) as hash
  from l4 where plain <> '' group by conv_id, turn, passage),
q as (
  select p.conv_id, p.turn, p.level, max(o.turn) as origin
  from p left join p o on o.level = 0 and o.conv_id = p.conv_id and o.hash = p.hash and o.turn < p.turn
  where p.level > 0 group by p.conv_id, p.turn, p.level, p.passage),
a as (
  select conv_id, turn, arg_min(origin, level * 1000000 - origin) filter (where origin is not null) as parent,
    count(*) as n_quoted, count(origin) as n_linked from q group by conv_id, turn),
r as (
  select m.conv_id, m.turn, m.turn as root, 0 as depth from mail m left join a using (conv_id, turn) where a.parent is null
  union all select a.conv_id, a.turn, r.root, r.depth + 1 from a join r on r.conv_id = a.conv_id and r.turn = a.parent),
b as (
  select conv_id, turn, trim(string_agg(raw, chr(10) order by n), chr(10)) as body from l2 where level = 0 group by conv_id, turn)
select m.conv_id, m.turn, m.role, a.parent, r.root, r.depth::bigint as depth, coalesce(a.n_quoted, 0)::bigint as n_quoted,
  coalesce(a.n_linked, 0)::bigint as n_linked, coalesce(b.body, '') as body
from mail m left join a using (conv_id, turn) join r using (conv_id, turn) left join b using (conv_id, turn)"""
