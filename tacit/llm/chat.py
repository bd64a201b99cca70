"""Chat formatting in budgeted windows, by DataFrame functions alone.

Prefix sums of turn tokens choose the windows.  A conversation has a room per window: the budget
less its system turn and less what is kept for history.  Cells of that many tokens lie over the
prefix sums, and a turn belongs to the cell it starts in.  Turns that end in their cell fit the
room together; the turn that runs over the end joins them if all still fit, else it is a window
of its own.  So every window is found from its own cell, and none passes the budget unless one
turn alone does.  A window opens with the system turn and the last turns of the window before it,
as history; both are masked.  The loss mask covers the assistant turns that are new in a window,
so every assistant text is learned once.

Template: ``<|im_start|>role LF text <|im_end|> LF``.  Inside roles and texts each ``<``, backslashes
and ``|`` in a row gets one backslash more, so no control string can occur in them, and taking one
away restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tacit.scratch import materialize

# Tokens of a window and of repeated history in it, and characters that count as a token.
BUDGET = 1024
HISTORY = 256
CHARS_PER_TOKEN = 4
# Turns whose sums are made apart, so that a very long conversation is not one group.
STRETCH = 256
# The control strings of the template.
START = "<|im_start|>"
END = "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles end at the line end, so theirs are written out."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(
        F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")
    )


def _rows(conversations: DataFrame) -> DataFrame:
    """Turns with their rendered form, under a key that is never null."""
    rendered = F.concat(
        F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END)
    )
    return (
        conversations.select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .select(
            "conv_id",
            F.when(F.col("conv_id").isNull(), "none")
            .otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
            .alias("key"),
            "turn",
            "role",
            rendered.alias("shown"),
            F.xxhash64("role", "text").alias("hash"),
            F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / STRETCH).alias("stretch"),
        )
        .withColumn("size", F.ceil(F.length("shown") / CHARS_PER_TOKEN).cast("long"))
    )


def _placed(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with their place, the tokens up to their end, and the room of their conversation.

    Equal rows are numbered apart.  Sums run over stretches of a conversation and then over the
    sums of its stretches, so texts move once, with their stretch.
    """
    system = F.struct("turn", "role", "hash", "size")
    sums = rows.groupBy("key", "stretch").agg(
        F.sum("size").alias("tokens"),
        F.count(F.lit(1)).alias("turns"),
        F.min(F.when(F.lower("role") == "system", system)).alias("system"),
    )
    over = Window.partitionBy("key").orderBy("stretch")
    whole = Window.partitionBy("key")
    left = F.greatest(F.lit(0), budget - F.coalesce("head", F.lit(0)))
    kept = F.least(F.lit(history), F.floor(left / 2))
    sums = sums.select(
        "key",
        "stretch",
        (F.sum("tokens").over(over) - F.col("tokens")).alias("base"),
        (F.sum("turns").over(over) - F.col("turns")).alias("first"),
        F.min("system").over(whole)["size"].alias("head"),
    ).select("*", F.greatest(F.lit(1), left - kept).cast("long").alias("room"))
    inside = Window.partitionBy("key", "stretch").orderBy(
        F.asc_nulls_first("turn"), "role", "hash", "shown"
    )
    return (
        rows.select(
            "*",
            F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("to"),
            F.row_number().over(inside).alias("row"),
        )
        .join(sums, ["key", "stretch"])
        .select(
            "conv_id",
            "key",
            "room",
            (F.col("first") + F.col("row") - 1).alias("place"),
            (F.col("base") + F.col("to")).alias("end"),
            "size",
            "role",
            "shown",
        )
    )


def _cells(placed: DataFrame) -> DataFrame:
    """A row per cell that turns start in: its turns in order, as one or two windows.

    ``next`` is the cell of the turn that follows, if there is one.
    """
    turn = F.struct("place", "end", "size", "role", "shown")
    cells = placed.groupBy(
        "key", F.floor((F.col("end") - F.col("size")) / F.col("room")).alias("cell")
    ).agg(
        F.first("conv_id").alias("conv_id"),
        F.first("room").alias("room"),
        F.sort_array(F.collect_list(turn)).alias("turns"),
    )
    first, last = F.element_at("turns", 1), F.element_at("turns", -1)
    n = F.size("turns")
    runs_over = last["end"] > (F.col("cell") + 1) * F.col("room")
    total = last["end"] - first["end"] + first["size"]
    apart = runs_over & (n > 1) & (total > F.col("room"))
    return cells.select(
        "key",
        "cell",
        "conv_id",
        F.floor(last["end"] / F.col("room")).alias("next"),
        F.when(apart, F.array(F.slice("turns", F.lit(1), n - 1), F.array(last)))
        .otherwise(F.array("turns"))
        .alias("windows"),
    )


def _tail(turns: Column, most: int) -> Column:
    """The last turns of a window that hold ``most`` tokens at most."""
    end = F.element_at(turns, -1)["end"]
    return F.filter(turns, lambda t: end - t["end"] + t["size"] <= most)


def format_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """``(conv_id, window, text, loss, repeated, over)``: a row per window.

    System turn, history and new turns of a window hold ``budget`` tokens at most; only where one
    new turn with the system turn is more they pass it, with no other turn, and ``over`` says so.
    History is what still fits of the last ``history`` tokens of the window before.  The room
    kept for it is at most half of what the system turn leaves.  ``window`` numbers ascend with gaps.
    ``loss`` lists ``(start, length)`` character spans of ``text``, from 0; ``repeated`` counts the
    masked turns at its head.  The system turn is the first whose role is ``system`` in any case;
    windows before it go without.  Turns stay whole.  Null roles and texts count as empty; equal
    rows are turns of their own; a null conv_id is a conversation like any other; other columns
    are ignored.
    """
    if budget < 1 or not 0 <= history <= budget:
        raise ValueError("the history must fit the budget")
    placed = _placed(_rows(conversations), budget, history)
    # Read three times below; a cell holds at most a room and one turn.
    cells = materialize(_cells(placed), "chat-cells")
    # The first system turn of a conversation opens its later windows.
    systems = F.filter(F.flatten("windows"), lambda t: F.lower(t["role"]) == "system")
    first = cells.select("key", F.get(systems, F.lit(0)).alias("turn")).where("turn IS NOT NULL")
    first = first.groupBy("key").agg(F.min("turn").alias("system"))
    heads = cells.select("key", "cell").join(first, "key")
    # A conversation that ends within a cell has no next one.
    before = cells.where(F.col("next") > F.col("cell")).select(
        "key",
        F.col("next").alias("cell"),
        _tail(F.element_at("windows", -1), history).alias("before"),
    )
    parts = (
        cells.join(heads, ["key", "cell"], "left")
        .join(before, ["key", "cell"], "left")
        .select("conv_id", "cell", "system", "before", "windows", F.posexplode("windows"))
    )
    opening = F.element_at("col", 1)
    start = opening["end"] - opening["size"]
    tokens = F.element_at("col", -1)["end"] - start
    follows = F.col("system")["place"] < opening["place"]
    inner = _tail(F.element_at("windows", 1), history)
    parts = parts.select(
        "conv_id",
        (2 * F.col("cell") + F.col("pos")).cast("long").alias("window"),
        F.when(follows, F.col("system")).alias("system"),
        F.when(F.col("pos") == 1, inner).otherwise(F.col("before")).alias("before"),
        F.col("col").alias("new"),
        start.alias("start"),
        tokens.alias("tokens"),
    )
    head = F.coalesce(F.col("system")["size"], F.lit(0))
    free = F.least(F.lit(history), budget - head - F.col("tokens"))
    # The system turn as head makes its repetition as history needless.
    recent = F.filter(
        F.coalesce("before", F.array().cast(parts.schema["new"].dataType)),
        lambda t: (F.col("start") - t["end"] + t["size"] <= free)
        & ~t["place"].eqNullSafe(F.col("system")["place"]),
    )
    parts = parts.select(
        "conv_id",
        "window",
        (head + F.col("tokens") > budget).alias("over"),
        F.concat(F.array_compact(F.array("system")), recent).alias("old"),
        "new",
    )
    shown = F.transform(F.concat("old", "new"), lambda t: t["shown"])
    return parts.select(
        "conv_id",
        "window",
        F.array_join(shown, "").alias("text"),
        _spans(F.col("old"), F.col("new")).alias("loss"),
        F.size("old").alias("repeated"),
        "over",
    )


def _spans(old: Column, new: Column) -> Column:
    """Where the texts of new assistant turns lie, by one running pass."""
    ahead = F.aggregate(old, F.lit(0), lambda n, t: n + F.length(t["shown"]))
    opened = F.lit(len(START) + 1)
    run = F.aggregate(
        new,
        F.struct(
            ahead.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")
        ),
        lambda run, t: F.struct(
            (run["at"] + F.length(t["shown"])).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(
                    run["spans"],
                    F.array(
                        F.struct(
                            (run["at"] + opened + F.length(t["role"])).alias("start"),
                            (
                                F.length(t["shown"]) - opened - len(END) - F.length(t["role"])
                            ).alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(run["spans"])
            .alias("spans"),
        ),
    )
    return run["spans"]


def parse_windows(windows: DataFrame) -> DataFrame:
    """``(conv_id, window, turns, learned, chars)`` back from formatted windows.

    ``turns`` are the unescaped (role, text) of new turns and ``learned`` the texts under the mask.
    """
    pieces = F.split("text", r"<\|im_end\|>\n")
    whole = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    turns = F.transform(
        whole,
        lambda piece: F.struct(
            unescape_role(
                F.substr(
                    piece,
                    F.lit(len(START) + 1),
                    F.position(F.lit("\n"), piece) - len(START) - 1,
                )
            ).alias("role"),
            unescape(F.substr(piece, F.position(F.lit("\n"), piece) + 1)).alias("text"),
        ),
    )
    learned = F.transform(
        "loss",
        lambda span: unescape(F.substr(F.col("text"), span["start"] + 1, span["length"])),
    )
    return windows.select(
        "conv_id",
        "window",
        turns.alias("turns"),
        learned.alias("learned"),
        F.length("text").cast("long").alias("chars"),
    )
