"""Chat formatting from event logs, in DataFrame functions only.

Events are (conversation, turn, sequence, kind, role, text). A log is partitioned by
conversation and turn, sorted by sequence and folded:

* ``message`` (also null or unknown kinds) starts a message with the text,
* ``delta`` appends a streamed piece to the turn's last message,
* ``edit`` and ``regenerate`` replace that message's text (null: empty it, so that
  deltas may follow),
* ``delete`` removes the message.

Messages are then put in order of turn and rendered as
``<|im_start|>role\\ntext<|im_end|>\\n``. A ``<`` followed by backslashes and ``|``
inside a text or role gets one more backslash, so no control string can occur in a
text, and one backslash less restores it. A role's own backslashes and line feeds are
escaped as ``\\b`` and ``\\n``.

Defined results: null texts and roles are empty, repeated rows are repeated messages,
ties in the sequence go by kind, role and text; a null conversation id is one
conversation; an empty log gives no rows. Input columns other than the named ones are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of a log (conv_id, turn, seq, kind, role, text).

    Linear in the log: windows over (conversation, turn), one shuffle. A message keeps
    the events since its last reset, joined in order.
    """
    log = events.select(
        "conv_id", "turn", "seq", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("message").alias("kind"), "role", "text"
    )
    ordered = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text")
    numbered = log.select(
        "*",
        F.row_number().over(ordered).alias("pos"),
        F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("part"),
    )
    message = Window.partitionBy("conv_id", "turn", "part")
    kept = numbered.withColumn("reset", F.max(F.when(F.col("kind") != "delta", F.col("pos"))).over(message)).where(
        F.col("reset").isNull() | (F.col("pos") >= F.col("reset")) | F.col("role").isNotNull()
    )
    piece = F.when(F.col("reset").isNull() | (F.col("pos") >= F.col("reset")), F.struct("pos", F.when(F.col("kind") == "delete", "").otherwise(F.coalesce("text", F.lit(""))).alias("text")))
    return (
        kept.groupBy("conv_id", "turn", "part")
        .agg(
            F.array_sort(F.collect_list(piece)).alias("pieces"),
            F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("pos"))), F.lit("")).alias("role"),
            F.max_by("kind", "pos").alias("last_kind"),
        )
        .where(F.col("last_kind") != "delete")
        .select("conv_id", "turn", "part", "role", F.array_join(F.col("pieces.text"), "").alias("text"))
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points) of final messages."""
    rendered = messages.select(
        "conv_id",
        "turn",
        "part",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == trained_role).alias("trained"),
    ).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("turn", "part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("trained"), F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length")))
    return (
        placed.groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
            F.array_sort(F.collect_list(span)).alias("loss_spans"),
        )
        .select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")
    )


def read_back(formatted: Column) -> Column:
    """The messages, array<struct<role, text>>, that a rendered conversation holds."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, len(START) + 1, 2147483647))

    def message(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(piece, F.length(role) + 2)).alias("text"))

    return F.transform(bodies, message)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    under = F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(under, "")


def digest(rendered: DataFrame) -> DataFrame:
    """What reading the rendered conversations back gives, as counts and SHA-256 digests."""
    turns = F.transform(F.col("turns"), lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    return (
        rendered.withColumns({"turns": read_back(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of messages."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
