"""Chat formatting: conversations rebuilt from event logs, rendered with a template that can be read back.

Only DataFrame functions run here. A rendered turn is a line `<turn ROLE>`, the escaped text, and a line `</turn>`.
The escapes &amp; &lt; &gt; leave no angle bracket in a text or role, so only the template makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "conv_id long, seq long, turn long, op string, role string, text string"
TRAINED = "assistant"
TURN = r"<turn ([^<>]*)>\n([^<>]*)\n</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, turn, role, text) of a log of events (conv_id, seq, turn, op, role, text).

    Events of a conversation apply in the order of seq (ties: turn, op, role, text). `message` and `edit` set a turn's
    text, `delta` appends to it, `regenerate` empties it and drops what stands in it and in later turns. A turn whose
    events are all dropped is gone; its role is that of its last standing event that names one. Null texts are empty;
    a null conv_id is a conversation of its own and a null turn comes first; an empty log gives no messages.
    """
    order = [F.col("seq"), F.col("turn"), F.col("op"), F.col("role"), F.col("text")]
    after = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    same = Window.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    again = F.min(F.when(F.col("op") == "regenerate", F.coalesce("turn", F.lit(-1)))).over(after)
    reset = F.max(F.col("op").isin("message", "edit")).over(same)
    live = events.select("conv_id", "turn", "op", "role", "text", nth.alias("nth"), again.alias("again"), reset.alias("reset"))
    live = live.where((F.col("again").isNull() | (F.col("again") > F.coalesce("turn", F.lit(-1)))) & ~F.coalesce("reset", F.lit(False)))
    text = F.when(F.col("op") != "regenerate", F.coalesce("text", F.lit(""))).otherwise("")
    said = live.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("nth", text.alias("text")))).alias("parts"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("nth"))).alias("role"))
    return said.select("conv_id", "turn", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def logged(rows: DataFrame) -> DataFrame:
    """A log of whole messages from rows (conv_id, turn, role, text), in the order of turn, role and text, one turn each."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", nth.alias("seq"), nth.alias("turn"), F.lit("message").alias("op"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): each conversation's text, and the spans of it (code points) that carry loss.

    messages: conv_id, turn, role, text. Turns stand in ascending order (ties: role, text); the escaped texts of
    assistant turns carry loss. A null role is the empty one, which carries none.
    """
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("<turn "), role, F.lit(">\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    line = messages.select("conv_id", "turn", "role", "text", head.alias("head"), F.concat(head, text, F.lit("\n</turn>\n")).alias("line"), F.length(text).alias("chars"))
    ends = F.sum(F.length("line").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = line.select("conv_id", F.row_number().over(order).alias("nth"), "line", (ends - F.length("line") + F.length("head")).alias("start"), "chars", (F.col("role") == TRAINED).alias("trained"))
    spans = F.struct("nth", "line", "start", (F.col("start") + F.col("chars")).alias("end"), "trained")
    turns = at.groupBy("conv_id").agg(F.array_sort(F.collect_list(spans)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("formatted"), loss.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, roles, texts, loss_text, formatted_chars) read from the formatted text and its loss spans alone."""
    part = lambda k: F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(k)), unescaped)
    lost = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return rendered.select("conv_id", part(1).alias("roles"), part(2).alias("texts"), lost.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of conversations, read back from the output."""
    back = read_back(render(fold(logged(rows))))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return back.select("conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")
