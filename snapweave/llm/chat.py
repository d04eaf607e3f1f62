"""Conversations formatted into budgeted windows of whole turns, in built-in functions only.

A turn is written as ``<|turn|>role`` newline ``text<|end|>``, a repeated one
with ``<|past|>``. Inside roles and texts a backslash is written ``\\e``, ``<``
``\\l`` and ``[`` ``\\b`` (and a newline in a role ``\\n``), so no text can hold
a control string and unescaping gives the text back.

Windows take turns in order while the running sum of their tokens stays within
what a window holds of new turns: the whole budget in the first, later ones the
budget without ``history_tokens`` and without the system turn, if the
conversation starts with one. A turn longer than that has a window of its own.
Later windows begin with the system turn and the last turns before the window,
as many as fit ``history_tokens`` and ``history_turns``; what is repeated takes
only the room that the new turns leave, the system turn before the history. A
system turn of over half the budget isn't repeated and nothing is kept free for
it. So a window is over the budget only where it is one new turn that is longer
by itself. Loss spans cover the texts of assistant turns where they are new; in
repeated turns they are masked, so each counts once.

Turns are ordered by turn number, then role and text; null roles and texts are
empty, a null conversation id is a conversation of its own, rows that repeat a
turn are turns of their own, an empty table has no windows, and other columns
are ignored, whatever their names. One conversation is gathered in one task, as
its windows follow from one another; windows and history are found in one pass
over its token counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fill

NEW, PAST, CLOSE = "<|turn|>", "<|past|>", "<|end|>"
BUDGET, HISTORY_TOKENS, HISTORY_TURNS, OVERHEAD = 1024, 192, 4, 4
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def token_count(text: Column) -> Column:
    """Words and single marks, and OVERHEAD for what marks the turn."""
    return F.regexp_count(text, F.lit("\\w+|[^\\w\\s]")).cast("long") + OVERHEAD


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: conv_col, window, formatted, loss (array of start, end in code points), n_tokens."""
    if history_tokens < 0 or 2 * history_tokens >= budget:
        raise ValueError("the history must be shorter than half the budget")
    role, text = fill(role_col), fill(text_col)
    one = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), token_count(text).alias("tokens")).alias("t"))
    all_ = one.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    lead = F.col("t")[0]
    all_ = all_.withColumn("first", (lead["role"] == "system").cast("int"))
    all_ = all_.withColumn("system", F.slice("t", F.lit(1), F.when(lead["tokens"] * 2 <= budget, F.col("first")).otherwise(0)))
    all_ = all_.withColumn("kept", F.coalesce(F.get("system.tokens", F.lit(0)), F.lit(0).cast("long")))
    all_ = all_.withColumn("room", F.lit(budget) - history_tokens - F.col("kept"))

    def step(acc: Column, tokens: Column) -> Column:
        room = F.when(F.size(acc["starts"]) == 1, F.lit(budget)).otherwise(F.col("room"))
        goes = (acc["used"] > 0) & (acc["used"] + tokens > room)
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(goes, tokens).otherwise(acc["used"] + tokens).alias("used"),
            F.when(goes, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("used"), F.array(F.lit(0)).alias("starts"))
    all_ = all_.withColumn("starts", F.aggregate("t.tokens", zero, step, lambda acc: acc["starts"]))

    def window(start: Column, k: Column) -> Column:
        """The turns of a window, each with whether it is new."""
        end = F.coalesce(F.get("starts", k + 1), F.size("t"))
        new = F.aggregate(F.slice(F.col("t.tokens"), start + 1, end - start), F.lit(0).cast("long"), lambda acc, n: acc + n)
        led = F.col("kept") + new <= budget
        left = F.least(F.lit(history_tokens).cast("long"), budget - new - F.when(led, F.col("kept")).otherwise(0))

        def hold(acc: Column, tokens: Column) -> Column:
            more = acc["open"] & (acc["sum"] + tokens <= left)
            return F.struct((acc["sum"] + tokens).alias("sum"), (acc["n"] + more.cast("int")).alias("n"), more.alias("open"))

        far = F.greatest(F.least(F.lit(history_turns), start - F.col("first")), F.lit(0))
        before = F.reverse(F.slice(F.col("t.tokens"), F.greatest(start - far, F.lit(0)) + 1, far))
        n = F.aggregate(before, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open")), hold, lambda acc: acc["n"])

        def mark(new: bool):
            head = lambda t: F.concat(F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
            return lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escaped(t["text"]).alias("body"), t["tokens"].alias("tokens"), F.lit(new).alias("new"))

        fresh = F.transform(F.slice("t", start + 1, end - start), mark(True))
        again = F.transform(F.concat(F.slice("system", F.lit(1), led.cast("int")), F.slice("t", start - n + 1, n)), mark(False))
        return F.when(k == 0, fresh).otherwise(F.concat(again, fresh))

    each = all_.select("conv", F.posexplode(F.transform("starts", window)).alias("window", "p"))

    def measure(acc: Column, p: Column) -> Column:
        text_at = acc["at"] + len(NEW) + F.char_length(p["head"])
        end = text_at + F.char_length(p["body"])
        loss = p["new"] & (p["role"] == "assistant")
        return F.struct((end + len(CLOSE)).alias("at"), F.when(loss, F.concat(acc["loss"], F.array(F.struct(text_at.alias("start"), end.alias("end"))))).otherwise(acc["loss"]).alias("loss"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return each.select(
        F.col("conv").alias(conv_col),
        "window",
        F.array_join(F.transform("p", lambda p: F.concat(F.when(p["new"], NEW).otherwise(PAST), p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("p", nothing, measure, lambda acc: acc["loss"]).alias("loss"),
        F.aggregate("p", F.lit(0).cast("long"), lambda acc, p: acc + p["tokens"]).alias("n_tokens"),
    )


def read_back(formatted: str | Column) -> Column:
    """Array of (new, role, text): the turns that a formatted window holds."""
    f = F.col(formatted) if isinstance(formatted, str) else formatted
    pieces = F.filter(F.split(f, "<\\|end\\|>", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substr(x, F.lit(len(NEW) + 1))
        head = F.substring_index(body, "\n", 1)
        return F.struct(
            x.startswith(NEW).alias("new"),
            unescaped(F.replace(head, F.lit("\\n"), F.lit("\n"))).alias("role"),
            unescaped(F.substr(body, F.char_length(head) + 2)).alias("text"),
        )

    return F.transform(pieces, turn)


def masked_text(formatted: str, loss: str) -> Column:
    """What the loss spans cover, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(F.col(formatted), s["start"] + 1, s["end"] - s["start"]))), "")
