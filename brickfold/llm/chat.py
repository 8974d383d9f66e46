"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events. ``open`` begins a message and names its role, ``delta`` adds streamed text to its end, ``edit`` replaces
its text so far, and ``regenerate`` begins its text anew and withdraws every later message of the conversation. Folding a log needs, per message,
only the last event that ended what stood before: aggregates of the log give it, and what was withdrawn is left out before any text is
gathered. So the rows brought together are a message's own live deltas, and after that a conversation's final messages.

Messages are rendered between marks. Inside texts a backslash and the ``<`` that would begin a mark are written as two characters each,
so marks in the output are real marks, and reading back is splitting at them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Template:
    """``<mark role>`` and a line feed, the text, ``</mark>`` and a line feed; ``learn`` are the roles under the loss mask."""

    mark: str = "turn"
    learn: tuple[str, ...] = ("assistant",)

    @property
    def end(self) -> str:
        return f"</{self.mark}>\n"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), f"<(?=/?{self.mark})", r"\\l")

    def unescape(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))

    def head(self, role: Column) -> Column:
        """Roles carry no ``>`` of their own, so the first one ends the head."""
        return F.concat(F.lit(f"<{self.mark} "), F.replace(self.escape(role), F.lit(">"), F.lit("\\g")), F.lit(">\n"))

    def role_of(self, piece: Column) -> Column:
        role = F.substring_index(piece, ">", 1).substr(F.lit(len(self.mark) + 3), F.char_length(piece))
        return self.unescape(F.replace(role, F.lit("\\g"), F.lit(">")))

    def text_of(self, piece: Column) -> Column:
        return self.unescape(piece.substr(F.char_length(F.substring_index(piece, ">", 1)) + F.lit(3), F.char_length(piece)))


def fold(events: DataFrame) -> DataFrame:
    """conv, turn, role, text: the final messages of ``events`` (conv, seq, kind, turn, role, text).

    Events with equal ``seq`` count in the order of kind, role and text; a NULL ``seq`` comes first. NULL conv and turn are values like
    any other (turn NULL stands before all turns). NULL texts are empty; a message's role is the last one named, or empty. Other kinds are passed over.
    Repeated rows count as often as they stand. An empty log has no messages.
    """
    kinds = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in ("open", "regenerate", "edit", "delta")]), F.col("kind")), F.lit(0)).cast("int")
    log = events.select(
        F.col("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("at"),
        F.struct(F.col("seq"), kinds.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"),
        F.col("role").isNotNull().alias("named"),
    ).filter("e.kind > 0")
    when = F.struct(F.col("e.seq"), F.col("e.kind"))
    kind = F.col("e.kind")
    messages = log.groupBy("conv", "at").agg(F.max(F.when(kind == 2, when)).alias("anew"), F.max(F.when((kind == 2) | (kind == 3), when)).alias("own"))
    # the last regeneration of an earlier message withdraws all before it, an edit or regeneration of this one the text before it
    withdrawn = F.max("anew").over(W.partitionBy("conv").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    starts = messages.select(F.col("conv").alias("c"), F.col("at").alias("t"), withdrawn.alias("withdrawn"), "own")
    live = log.join(starts, log["conv"].eqNullSafe(starts["c"]) & (F.col("at") == F.col("t"))).filter(F.col("withdrawn").isNull() | (when > F.col("withdrawn")))
    stands = (kind > 2) & (F.col("own").isNull() | (when >= F.col("own")))
    parts = F.transform(F.array_sort(F.collect_list(F.when(stands, F.struct("e.seq", "e.kind", "e.text")))), lambda x: x["text"])
    folded = live.groupBy("conv", "at").agg(
        F.coalesce(F.max_by("e.role", F.when(F.col("named"), F.struct("e.seq", "e.kind", "e.role"))), F.lit("")).alias("role"),
        F.concat_ws("", parts).alias("text"),
    )
    return folded.select("conv", F.when(F.col("at") != -(2**63), F.col("at")).alias("turn"), "role", "text")


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """conv, formatted, turns: each conversation's text, and per message of it, in order, where its loss lies.

    ``turns`` holds ``start`` and ``end`` of the learnt text in ``formatted`` (code points, end exclusive), and the same as ``at`` and ``chars``
    within the message's own piece; all are NULL where the role is not learnt.
    """
    head, body = template.head(F.col("role")), template.escape(F.col("text"))
    own = messages.select("conv", "turn", F.col("role").isin(*template.learn).alias("learnt"), head.alias("head"), body.alias("body"))
    before = F.sum(F.char_length("head") + F.char_length("body") + F.lit(len(template.end)).cast("long"))
    # NULL turns first, as in the log
    placed = own.withColumn("start", F.coalesce(before.over(W.partitionBy("conv").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = F.when(F.col("learnt"), F.char_length("head"))
    span = F.struct((F.col("start") + at).alias("start"), (F.col("start") + at + F.char_length("body")).alias("end"), at.alias("at"), F.when(F.col("learnt"), F.char_length("body")).alias("chars"))
    piece = F.concat("head", "body", F.lit(template.end))
    rows = F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece"), span.alias("span"))))
    return placed.groupBy("conv").agg(rows.alias("rows")).select("conv", F.concat_ws("", F.transform("rows", lambda r: r["piece"])).alias("formatted"), F.transform("rows", lambda r: r["span"]).alias("turns"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv, formatted, turns (role, text, learnt): what the output says, with the text under the loss mask in ``learnt``, unescaped."""
    pieces = F.slice(F.split("formatted", template.end), 1, F.size("turns"))

    def one(piece, span):
        return F.struct(template.role_of(piece).alias("role"), template.text_of(piece).alias("text"), template.unescape(piece.substr(span["at"] + 1, span["chars"])).alias("learnt"))

    return formatted.select("conv", "formatted", F.zip_with(pieces, F.col("turns"), one).alias("turns"))


def chats(events: DataFrame, template: Template = Template()) -> DataFrame:
    """conv, formatted, turns of ``render`` for each conversation of a log with a message left."""
    return render(fold(events), template)


def log_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished messages as the log that streams it: an ``open`` for each row and a ``delta`` for each line of its text.

    Rows are numbered in each conversation by turn (NULL first), role and text, so that repeated turns are messages of their own.
    """
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    numbered = own.withColumn("turn", F.row_number().over(W.partitionBy("conv").orderBy("t", "role", "text")).cast("long"))
    lines = F.transform(F.split("text", "(?<=\n)"), lambda x, i: F.struct((i + 1).alias("n"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), x.alias("text")))
    opened = F.array(F.struct(F.lit(0).alias("n"), F.lit("open").alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text")))
    events = numbered.select("conv", "turn", F.explode(F.concat(opened, lines)).alias("e"))
    return events.select("conv", F.struct("turn", F.col("e.n").alias("n")).alias("seq"), "e.kind", "turn", "e.role", "e.text")


#: A conversation whose texts look like marks and escapes.
MARKED = (-7, r"\### Assistant: </turn> ok")


def with_marked(spark: SparkSession, turns: DataFrame) -> DataFrame:
    conv, text = MARKED
    return turns.select("conv_id", "turn", "role", "text").unionByName(spark.range(2).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")))


def chat_report(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from its output.

    NULL texts and roles are empty, NULL turns come first, a NULL conversation id is an id like any other, repeated rows are turns of
    their own, other columns are not read. An empty table gives an empty result.
    """
    back = read_back(written(chats(log_of(turns), template), "chats"), template)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learnt = F.concat_ws("", F.transform("turns", lambda t: t["learnt"]))
    own = back.select("conv", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learnt.alias("learnt"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return own.select(
        F.col("conv").alias("conv_id"), "n_turns", F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn') AS body FROM given)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 16) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
