r"""Relational chat formatting: Spark expressions only.

The template of a message is ``### role: text</turn>`` and a line feed. Adjacent turns of one role become one
message whose texts stand apart by ``<+>``, so that the turns can be read back. Inside roles and texts a backslash
becomes ``\\``, ``##`` becomes ``#\#``, ``</turn>`` becomes ``<\/turn>`` and ``<+>`` becomes ``<\+>`` (in roles also
``:`` becomes ``\:``): no control string is left, and dropping each backslash before a character gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
OPEN, NAMED, BETWEEN, CLOSE = "### ", ": ", "<+>", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>"), ("<+>", "<\\+>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, formatted, loss_spans (start and length in code points, one for each turn of loss_role).

    Turns are sorted by turn, then role, then text (nulls first), so ties have one order; repeated rows stay. A null
    role or text is empty; rows with a null id are one conversation. An empty table gives no rows; other columns
    aren't read. A conversation is one output value, so its turns meet in one task; partial collection comes first.
    """
    plain = turns.select(F.col(id_col).alias("__id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("__turn"))
    sorted_ = plain.groupBy("__id").agg(F.array_sort(F.collect_list("__turn")).alias("t"))
    first = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.get(F.col("t"), i - 1)["role"] != F.get(F.col("t"), i - 2)["role"]))
    runs = sorted_.withColumn("first", first)
    merged = runs.select(
        "__id",
        F.transform(
            "first",
            lambda at, k: F.struct(
                F.get(F.col("t"), at - 1)["role"].alias("role"),
                F.transform(F.slice(F.col("t"), at, F.coalesce(F.get(F.col("first"), k + 1), F.size("t") + 1) - at), lambda x: escape(x["text"])).alias("texts"),
            ),
        ).alias("messages"),
    )
    head = lambda role: F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(NAMED))
    pieces = merged.select(
        "__id",
        F.array_join(F.transform("messages", lambda m: F.concat(head(m["role"]), F.array_join(m["texts"], BETWEEN), F.lit(CLOSE))), "").alias("formatted"),
        # what stands before each text, and its length
        F.flatten(
            F.transform(
                "messages",
                lambda m, k: F.transform(
                    m["texts"],
                    lambda t, j: F.struct(
                        (F.when(j > 0, F.lit(len(BETWEEN))).otherwise(F.length(head(m["role"])) + F.when(k > 0, len(CLOSE)).otherwise(0))).alias("before"),
                        F.length(t).alias("length"),
                        (m["role"] == loss_role).alias("loss"),
                    ),
                ),
            )
        ).alias("texts"),
    )
    spans = F.aggregate(
        "texts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["before"] + t["length"]).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["before"]).alias("start"), t["length"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return pieces.select(F.col("__id").alias(id_col), "formatted", spans.alias("loss_spans"))


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    messages = F.filter(F.split(formatted, r"</turn>\n"), lambda m: m != "")
    named = r"(?s)^### ((?:[^:\\]|\\.)*): (.*)$"
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(F.split(F.regexp_extract(m, named, 2), r"<\+>"), lambda t: F.struct(unescape(F.regexp_extract(m, named, 1)).alias("role"), unescape(t).alias("text"))),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
