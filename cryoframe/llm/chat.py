"""Chat formatting from an event log (operator 7). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template. Texts and roles hold no "<" once escaped, so neither mark can stand inside them.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Characters of a streamed delta.
CHUNK = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("|"), F.lit("&bar;")), F.lit("\n"), F.lit("&#10;"))


def unescape(text: Column) -> Column:
    for mark, plain in (("&#10;", "\n"), ("&bar;", "|"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def event_log(turns: DataFrame) -> DataFrame:
    """conv_id, message, seq, role, kind, text: the events that a chat service would have logged for rows (conv_id, turn, role, text).

    A user's text is a draft that an edit replaces; an assistant's is begun, regenerated and streamed in deltas; others
    are streamed. Rows of one turn are messages in order of role and text; each row is a message of its own, also where it
    repeats another.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    event = lambda seq, kind, t: F.struct(seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), t.alias("text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    half = F.expr("substring(text, 1, length(text) div 2)")
    streamed = F.transform(
        F.sequence(F.lit(0), F.expr(f"greatest(0, (length(text) - 1) div {CHUNK})").cast("int")),
        lambda i: event(i + 2, "delta", F.substr(F.col("text"), i * CHUNK + 1, F.lit(CHUNK))),
    )
    begun = event(F.lit(0), "delta", half)
    events = (
        F.when(F.col("role") == "user", F.array(begun, event(F.lit(1), "edit", F.col("text"))))
        .when(F.col("role") == "assistant", F.concat(F.array(begun, event(F.lit(1), "regenerate", F.lit(""))), streamed))
        .otherwise(streamed)
    )
    message = F.struct("turn", "place").alias("message")
    return rows.select("conv_id", message, "role", F.explode(events).alias("e")).select("conv_id", "message", "role", "e.seq", "e.kind", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: each message as its events leave it.

    Events of a message count in order of ``seq``: a delta adds its text, an edit or a regeneration replaces all before
    it by its own text. Deltas with the number of a replacement come before it. An event delivered twice counts once;
    null texts are empty; of several roles the largest stands.
    """
    e = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    folded = events.groupBy("conv_id", "message").agg(F.max(F.coalesce("role", F.lit(""))).alias("role"), F.array_sort(F.collect_set(e)).alias("log"))
    since = F.array_max(F.transform(F.filter("log", lambda x: x["kind"] != "delta"), lambda x: x["seq"]))
    counts = lambda x: F.col("since").isNull() | (x["seq"] > F.col("since")) | ((x["seq"] == F.col("since")) & (x["kind"] != "delta"))
    text = F.array_join(F.transform(F.filter("log", counts), lambda x: x["text"]), "")
    return folded.withColumn("since", since).select("conv_id", "message", "role", text.alias("text"))


def render(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one row a conversation, messages in order.

    loss_spans are places (code points, end exclusive) in ``formatted`` of the texts of role ``learned``. A conversation
    is one training text, so its own length bounds the row; a null conv_id is a conversation like any other.
    """
    in_order = Window.partitionBy("conv_id").orderBy("message")
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(CLOSE))
    rows = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("turn_text", F.concat("head", "body", F.lit(END)))
    upto = F.sum(F.char_length("turn_text").cast("bigint")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    start = upto - F.char_length("turn_text") + F.char_length("head")
    rows = rows.withColumn("start", start).withColumn("end", F.col("start") + F.char_length("body"))
    span = F.when(F.col("role") == learned, F.struct("start", "end"))
    turns = F.array_sort(F.collect_list(F.struct("message", "turn_text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("formatted"), "loss_spans"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_texts: what a formatted conversation says, unescaped."""
    parts = F.slice(F.col("parts"), F.lit(1), F.size("parts") - 1)
    role = lambda p: F.substring_index(F.substr(p, F.lit(3)), CLOSE, 1)
    turn = lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.char_length(role(p)) + len(OPEN) + len(CLOSE) + 1)).alias("text"))
    split = formatted.withColumn("parts", F.split("formatted", r"<\|end\|>\n", -1)).withColumn("parts", parts)
    # Where each part begins, once for all, so that no text is looked for from the start of the conversation.
    none = F.struct(F.array().cast("array<bigint>").alias("begins"), F.lit(0).cast("bigint").alias("at"))
    step = lambda a, p: F.struct(F.concat(a["begins"], F.array(a["at"])).alias("begins"), (a["at"] + F.char_length(p) + len(END)).alias("at"))
    split = split.withColumn("begins", F.aggregate("parts", none, step, lambda a: a["begins"]))
    begin = lambda p, b: b + F.char_length(role(p)) + len(OPEN) + len(CLOSE)
    span = lambda p, b: F.struct(begin(p, b).alias("start"), (b + F.char_length(p)).alias("end"))
    spoken = F.zip_with("parts", "begins", lambda p, b: F.when(F.array_contains("loss_spans", span(p, b)), turn(p)["text"]))
    return split.select("conv_id", "formatted", F.transform("parts", turn).alias("turns"), F.filter(spoken, lambda t: t.isNotNull()).alias("loss_texts"))


def report(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rows (conv_id, turn, role, text), all read back from the formatted text.

    Null text or role counts as empty. Rows of one turn go by role, then text; a row repeated
    in all four columns is a turn as often as it stands there. A null turn comes first. An empty table gives an empty report.
    """
    back = read_back(render(fold(event_log(turns))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("loss", F.array_join("loss_texts", "")).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
