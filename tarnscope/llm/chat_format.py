"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(text: Column) -> Column:
    """Add a backslash to every run of backslashes between ``<`` and ``|``; no ``<|`` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line: line feeds and backslashes are escaped as well."""
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape_text(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def expand_chats(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One training example for every assistant turn: all turns before it as context, and only its
    own text trainable.

    Returns ``conversation, example, last, text, loss_start, loss_end``; the span counts code points,
    end exclusive. Turns after the last reply make one more example without a trainable span, so that
    the last example of a conversation holds all of its turns.

    Null text and null roles are empty; an empty reply makes an example with an empty span. Turns are
    ordered by number (null first), then role and text, so ties and repeated rows have one order.
    Rows without a conversation are one conversation with a null id. Other columns are ignored. An
    empty table gives no rows. An example holds its whole context by definition, so the turns of one
    conversation are gathered in one row.
    """
    rows = turns.select(
        F.col(conversation).alias("conversation"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"),
    )
    chats = rows.groupBy("conversation").agg(F.array_sort(F.collect_list("said")).alias("said"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    chats = chats.select("conversation", "said", F.transform("said", lambda t: F.concat(head(t), escape_text(t["text"]), F.lit(END))).alias("pieces"))
    replies = F.filter(F.transform("said", lambda t, i: F.when(t["role"] == target, i)), lambda i: i.isNotNull())
    n = F.size("said")
    ends = F.when(F.element_at("said", -1)["role"] == target, replies).otherwise(F.concat(replies, F.array(n)))
    chats = chats.select("conversation", "said", "pieces", F.posexplode(ends).alias("example", "at"))
    reply = F.get("said", F.col("at"))
    prefix = F.array_join(F.slice("pieces", F.lit(1), F.col("at")), "")
    parts = chats.select(
        "conversation", "example", (F.col("at") >= n - 1).alias("last"), prefix.alias("prefix"),
        F.coalesce(head(reply), F.lit("")).alias("head"), F.coalesce(escape_text(reply["text"]), F.lit("")).alias("reply"),
        F.when(reply.isNotNull(), F.lit(END)).otherwise("").alias("end"),
    )
    start = F.length("prefix") + F.length("head")
    return parts.select(
        "conversation", "example", "last", F.concat("prefix", "head", "reply", "end").alias("text"),
        start.alias("loss_start"), (start + F.length("reply")).alias("loss_end"),
    )


def parse_chat(text: Column) -> Column:
    """The turns of a formatted text as an array of ``role, text``."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(START) + 1))
        cut = F.locate("\n", body)
        return F.struct(unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape_text(F.substr(body, cut + 1)).alias("text"))

    return F.transform(pieces, turn)


def chat_digests(examples: DataFrame) -> DataFrame:
    """Read every conversation back from its examples: turns, trainable text and size."""
    loss = unescape_text(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = examples.select(
        "conversation", F.struct("example", loss.alias("loss")).alias("loss"), F.length("text").cast("long").alias("chars"),
        F.when(F.col("last"), F.col("text")).alias("whole"),
    )
    chats = rows.groupBy("conversation").agg(F.array_sort(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("chars"), F.max("whole").alias("whole"))
    chats = chats.select("conversation", "chars", F.array_join(F.transform("loss", lambda x: x["loss"]), "").alias("loss"), parse_chat(F.col("whole")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        F.col("conversation").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )
