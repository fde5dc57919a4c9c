"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

An event log (conv_id, seq, msg, kind, role, text) is dealt by conversation, ordered by
`seq` and folded into final messages:

* ``message`` starts a message, ``delta`` appends to it, ``edit`` replaces its text;
* ``regenerate`` replaces the text too and drops the messages that stood after it then;
* a dropped message stays dropped, and its later events are void.

Messages stand in the order of their first event. Each is rendered as

    <|turn|>role<|text|>text<|end|>

where ``&``, ``<`` and ``[`` inside roles and texts become ``&amp;``, ``&lt;`` and
``&lsqb;``. No marker or other model's control string can therefore arise from content,
and undoing the three replacements in reverse order gives the content back exactly.

Defined results: null roles and texts are empty; events without a conversation are one
conversation with a null id; equal `seq` are taken by message, kind, role and text;
deltas before any message event start the message; an empty log gives no conversations;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def in_force(regenerated: Column) -> Column:
    """Of an ordered array of regenerations (n: when, born: when its message began), those
    whose message had not been dropped. One in force drops the messages born between `born`
    and `n`; later ones lie beyond that or take it in, so the state is a list of gaps."""

    def step(gaps: Column, r: Column) -> Column:
        dropped = F.exists(gaps, lambda g: (g["born"] < r["born"]) & (r["born"] < g["n"]))
        outside = F.filter(gaps, lambda g: g["born"] < r["born"])
        return F.when(dropped, gaps).otherwise(F.array_append(outside, r))

    return F.aggregate(regenerated, F.array().cast("array<struct<n:int,born:int>>"), step)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, pos, role, text) of an event log."""
    e = events.select("conv_id", "seq", "msg", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("seq").asc_nulls_first(), "msg", "kind", "role", "text"]
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    of_msg = Window.partitionBy("conv_id", "msg")
    e = e.withColumn("reset", F.max(F.when(F.col("kind") != "delta", F.col("n"))).over(of_msg))
    e = e.withColumn("born", F.min("n").over(of_msg))
    live = e.where(F.col("reset").isNull() | (F.col("n") >= F.col("reset")))
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    msgs = live.groupBy("conv_id", "msg", "born").agg(
        F.max_by("role", F.struct(F.col("role") != "", -F.col("n"))).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )
    redone = e.where(F.col("kind") == "regenerate").groupBy(F.col("conv_id").alias("conv2")).agg(F.array_sort(F.collect_list(F.struct("n", "born"))).alias("r"))
    gaps = redone.select("conv2", F.explode(in_force(F.col("r"))).alias("g")).select("conv2", F.col("g.born").alias("born2"), F.col("g.n").alias("redone"))
    same = F.col("conv_id").eqNullSafe(F.col("conv2")) & (F.col("born") == F.col("born2"))
    msgs = msgs.join(gaps, same, "left").drop("conv2", "born2")
    earlier = Window.partitionBy("conv_id").orderBy("born").rowsBetween(Window.unboundedPreceding, -1)
    msgs = msgs.withColumn("cut", F.max("redone").over(earlier)).where(F.col("cut").isNull() | (F.col("cut") < F.col("born")))
    return msgs.select("conv_id", F.col("born").alias("pos"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one text per conversation and the character spans
    [start, end) of assistant texts in it."""
    piece = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END))
    m = messages.select("conv_id", "pos", (F.col("role") == "assistant").alias("own"), piece.alias("piece"))
    m = m.withColumn("stop", F.sum(F.length("piece").cast("long")).over(Window.partitionBy("conv_id").orderBy("pos")))
    stop = F.col("stop") - len(END)
    head = len(TURN) + len("assistant") + len(TEXT)
    span = F.when(F.col("own"), F.struct((F.col("stop") - F.length("piece") + head).alias("start"), stop.alias("end")))
    m = m.select("conv_id", "pos", "piece", span.alias("span"))
    got = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "span"))).alias("m"))
    spans = F.filter(F.transform("m", lambda x: x["span"]), lambda s: s.isNotNull())
    return got.select("conv_id", F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t != "")

    def turn(t: Column) -> Column:
        both = F.split(F.replace(t, F.lit(TURN), F.lit("")), r"<\|text\|>")
        return F.struct(unescape(F.get(both, F.lit(0))).alias("role"), unescape(F.get(both, F.lit(1))).alias("text"))

    return F.transform(turns, turn)


def table_events(conversations: DataFrame) -> DataFrame:
    """Rows of a turn table as the log of a chat in which they came about. In turn, a message is
    streamed in two deltas; or a draft is edited into it; or a first answer and a message that
    follows it are undone by a regeneration, which is streamed too."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")
    rows = conversations.select("conv_id", n.alias("n"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = (F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def events(*parts) -> Column:
        made = [(F.lit(10) * F.col("n") + i, F.col("n") if own else -F.col("n"), kind, text) for i, (own, kind, text) in enumerate(parts)]
        return F.array(*[F.struct(seq.alias("seq"), msg.alias("msg"), F.lit(kind).alias("kind"), (F.lit(text) if isinstance(text, str) else text).alias("text")) for seq, msg, kind, text in made])

    streamed = events((True, "message", ""), (True, "delta", first), (True, "delta", rest))
    edited = events((True, "message", "a draft"), (True, "delta", " cut off"), (True, "edit", F.col("text")))
    redone = events((True, "message", "another "), (True, "delta", F.col("text")), (False, "message", "and what"), (False, "delta", " follows"), (True, "regenerate", first), (True, "delta", rest))
    log = F.when(F.col("n") % 3 == 0, streamed).when(F.col("n") % 3 == 1, redone).otherwise(edited)
    return rows.select("conv_id", "role", F.explode(log).alias("e")).select("conv_id", "e.seq", "e.msg", "e.kind", "role", "e.text")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss mask hold."""
    turns = parse(F.col("formatted"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    loss = F.array_join(masked, "")
    return formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(render(fold_events(table_events(rows.unionByName(probe)))))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + 23 AS shown FROM c
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
