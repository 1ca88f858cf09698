"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into spans of whole turns. A window is the system turn,
the last turns of the span before it as history, and the span; only what assistants say in the
span is a target, so every target is learnt once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, of them for history at most, and turns that one task sums up together.
BUDGET, HISTORY, CHUNK = 1024, 256, 256
#: Marks of the template, and what stands for them inside texts.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = [("\\", "\\b"), ("</turn>", "\\t"), ("### ", "\\h"), (":", "\\c")]


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column, role: bool = False) -> Column:
    """``text`` without marks. Each backslash of the result opens an escape, so it can be undone."""
    return _replaced(text, ESCAPES if role else ESCAPES[:3])


def unescaped(text: Column) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(ESCAPES)])


def estimated_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=estimated_tokens) -> DataFrame:
    """``conv_id, window, text, n_tokens, n_repeated, loss`` for each window of ``turns``
    (conv_id, turn, role, text).

    ``window`` is the number of the first turn that is new in it, ``n_repeated`` counts the leading
    turns that are not, and ``loss`` holds start and length (code points) of the assistant texts
    that are new. A window holds ``budget`` tokens at most, unless a single turn is longer than what
    the system turn and the history leave, half of it at least; such a turn has a window alone.

    Turns are ordered by turn, role and text; a null turn comes first, null roles and texts are
    empty, repeated rows are turns of their own, rows without a conv_id are left out, other columns
    are ignored, and no rows give no windows. The first turn of role system is the system turn.

    Prefix sums are taken within chunks of turn numbers and over the sums of the chunks, so a
    long conversation is not one task; windows are small by construction.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said"),
    )
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), role=True), F.lit(MIDDLE))
    rows = rows.withColumn("head", F.length(head)).withColumn("body", F.concat(head, escaped(F.col("said")), F.lit(CLOSE)))
    rows = rows.withColumn("tokens", tokens(F.col("body")).cast("long")).drop("said")
    order = F.struct("turn", "role", "body")
    system = rows.where("role = 'system'").groupBy("conv_id").agg(
        F.min_by(F.struct("turn", "role", "body", "tokens"), order).alias("system")
    )
    rows = rows.join(system, "conv_id", "left")
    room = budget - history - F.coalesce("system.tokens", F.lit(0))
    rows = rows.withColumn("half", F.greatest(F.floor(room / 2), F.lit(1)))
    rows = rows.withColumn("long", (F.col("tokens") > F.col("half")).cast("int"))
    rows = rows.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK))
    # Places and sums within chunks, then what stands before each chunk.
    sums = {"at": F.lit(1), "end": F.col("tokens"), "longs": F.col("long")}
    inner = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, 0)
    before = rows.groupBy("conv_id", "chunk").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    outer = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("conv_id", "chunk", *(F.coalesce(F.sum(k).over(outer), F.lit(0)).alias(f"{k}_before") for k in sums))
    rows = rows.select("*", *(F.sum(c).over(inner).alias(k) for k, c in sums.items())).join(before, ["conv_id", "chunk"])
    rows = rows.select(
        "conv_id", "turn", "role", "head", "body", "tokens", "system", "long",
        *((F.col(k) + F.col(f"{k}_before")).alias(k) for k in sums),
        F.floor((F.col("end") + F.col("end_before") - F.col("tokens")) / F.col("half")).alias("block"),
    )
    # A long turn is a span alone; between long turns a span is what starts in one block of tokens.
    span = Window.partitionBy("conv_id", "longs", "long", "block")
    block = F.when(F.col("long") == 0, F.col("block")).otherwise(F.lit(-1))
    rows = rows.withColumn("block", block).select(
        "*", F.min("at").over(span).alias("first"), F.max("at").over(span).alias("last"), F.max("end").over(span).alias("stop")
    )
    again = F.col("stop") - (F.col("end") - F.col("tokens")) <= history
    uses = F.array_compact(F.array(
        F.struct(F.col("first").alias("window"), F.lit(True).alias("new")),
        F.when(again, F.struct((F.col("last") + 1).alias("window"), F.lit(False).alias("new"))),
    ))
    rows = rows.withColumn("use", F.explode(uses)).withColumn("window", F.col("use.window")).withColumn("new", F.col("use.new"))
    group = Window.partitionBy("conv_id", "window")
    is_system = F.struct("turn", "role", "body") == F.struct("system.turn", "system.role", "system.body")
    rows = rows.select(
        "*", F.max("new").over(group).alias("any_new"),
        F.max(F.coalesce(is_system, F.lit(False))).over(group).alias("has_system"),
        F.coalesce(F.sum(F.length("body")).over(group.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    ).where("any_new")
    lead = F.when(F.col("system").isNotNull() & ~F.col("has_system"), F.col("system.body"))
    rows = rows.withColumn("lead", lead)
    start = F.coalesce(F.length("lead"), F.lit(0)) + F.col("offset") + F.col("head")
    loss = F.when(
        F.col("new") & (F.col("role") == "assistant"),
        F.struct(start.cast("long").alias("start"), (F.length("body") - F.col("head") - len(CLOSE)).cast("long").alias("length")),
    )
    out = rows.withColumn("loss", loss).groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("at", "body", "loss"))).alias("parts"),
        F.first("lead").alias("lead"), F.first("system.tokens").alias("lead_tokens"),
        F.sum("tokens").alias("n_tokens"), F.sum((~F.col("new")).cast("int")).alias("n_repeated"),
    )
    led = F.col("lead").isNotNull()
    return out.select(
        "conv_id", "window",
        F.concat(F.coalesce("lead", F.lit("")), F.array_join("parts.body", "")).alias("text"),
        (F.col("n_tokens") + F.when(led, F.col("lead_tokens")).otherwise(0)).alias("n_tokens"),
        (F.col("n_repeated") + led.cast("int")).alias("n_repeated"),
        F.array_compact("parts.loss").alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """``conv_id, window, turns, targets`` read back from formatted windows.

    ``turns`` are role and text of the window's new turns, ``targets`` the texts under its loss mask.
    """
    pieces = F.split("text", F.lit(CLOSE))
    new = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated").cast("int"), F.lit(0)))

    def turn(piece):
        colon = F.instr(piece, MIDDLE)
        role = F.substring(piece, F.lit(len(OPEN) + 1), colon - 1 - len(OPEN))
        text = F.substring(piece, colon + len(MIDDLE), F.length(piece))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    targets = F.transform("loss", lambda x: unescaped(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return windows.select("conv_id", "window", F.transform(new, turn).alias("turns"), targets.alias("targets"))
