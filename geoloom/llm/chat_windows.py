"""Formatting conversations as budgeted windows with a loss mask.

DataFrame operations only. Each window retains the system turn, repeats the last ``history`` turns
before it (of ``history_tokens`` together at most) and then has its own span of turns. What is left of the budget for a span is
its *room*: the budget without the system turn and without ``history_tokens``. The tokens of the other turns
are summed up in order, and the sums choose the spans: a turn of half the room or more is a span
of its own, the others are cut where their running sum passes a multiple of half the room, so a
span of several turns stays within the room. History is repeated only as far as the window stays within
the budget. So a window passes the budget only if the system turn, alone or with one turn of a span of its own, does: texts are never cut.
The loss mask covers the text of the span's own assistant turns; repeated targets are masked, so every assistant text is learnt once.

Template: ``<|turn|>`` role newline text ``<|end|>`` newline. Control strings inside texts are
escaped reversibly with ``&`` codes.

Null text or role: empty. Null turn numbers come first; turns that tie, and repeated rows, are turns each, in order of role
and text. A null conv_id is a conversation. A conversation without assistant turns has an empty mask; an empty table has no
windows. Other columns are not looked at and not returned. A conversation is one task's, as its running sums need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Strings that chat templates treat as control; texts must not hold them raw.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """``&`` becomes ``&amp;`` and the i-th control string ``&c<i>;``."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for i, control in enumerate(CONTROL):
        out = F.replace(out, F.lit(control), F.lit(f"&c{i};"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for i, control in reversed(list(enumerate(CONTROL))):
        out = F.replace(out, F.lit(f"&c{i};"), F.lit(control))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def count_tokens(text: Column) -> Column:
    """Words and marks of a text, and four for the template."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long") + 4


def windows(df: DataFrame, budget: int = 1024, history: int = 2, history_tokens: int = 256) -> DataFrame:
    """(conv_id, window, text, n_context, loss) of rows (conv_id, turn, role, text).

    ``n_context`` turns at the head of a window are repeated; ``loss`` has the first and the
    past-the-end code point of each piece of ``text`` under the loss mask.
    """
    rows = df.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body")
    ).withColumn("tokens", count_tokens(F.col("body")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("is_system", (F.col("role") == "system") & (F.col("at") == 1))
    rows = rows.withColumn("system", F.max(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(whole))
    half = F.greatest(F.lit(1), F.floor((budget - F.col("system") - history_tokens) / 2))
    counted = F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))
    rows = rows.withColumns({"half": half, "counted": counted}).withColumn("is_long", F.col("counted") >= F.col("half"))
    rows = rows.withColumns(
        {
            "short_before": F.coalesce(F.sum(F.when(~F.col("is_long"), F.col("counted"))).over(before), F.lit(0)),
            "long_before": F.coalesce(F.sum(F.col("is_long").cast("long")).over(before), F.lit(0)),
            "all_before": F.coalesce(F.sum("counted").over(before), F.lit(0)),
        }
    )
    by_at = Window.partitionBy("conv_id").orderBy("at")
    # the system turn counts nothing, so it is in the span of the turn after it unless that is a long one
    mark = F.struct("is_long", "long_before", F.when(~F.col("is_long"), F.floor(F.col("short_before") / F.col("half"))).alias("cut"))
    rows = rows.withColumn("mark", mark)
    rows = rows.withColumn("starts", (~F.col("mark").eqNullSafe(F.lag("mark").over(by_at))).cast("long"))
    rows = rows.withColumn("window", F.sum("starts").over(by_at.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("spare", budget - F.col("system") - F.sum("counted").over(Window.partitionBy("conv_id", "window")))
    ahead = [F.lead(F.struct("window", "all_before", "spare"), k).over(by_at) for k in range(1, history + 1)]
    rows = rows.select(
        "conv_id", "at", "role", "body", "window", "all_before", "is_system",
        F.array_compact(F.array(*ahead)).alias("ahead"),
        F.max("window").over(whole).alias("last"),
    )
    # a later window is met first at its first turn: what is between that and here would be repeated with it
    met = F.filter("ahead", lambda w, i: (w["window"] > F.col("window")) & ((i == 0) | (F.get(F.col("ahead"), i - 1)["window"] < w["window"])))
    fits = F.filter(met, lambda w: w["all_before"] - F.col("all_before") <= F.least(F.lit(history_tokens), w["spare"]))
    later = F.transform(fits, lambda w: w["window"])
    none = F.array().cast("array<bigint>")
    again = F.when(F.col("is_system"), F.when(F.col("last") > F.col("window"), F.sequence(F.col("window") + 1, F.col("last"))).otherwise(none)).otherwise(later)
    placed = rows.select(
        "conv_id", "at", "role", "body", F.col("window").alias("own"), F.explode(F.concat(F.array("window"), again)).alias("window")
    )
    text = escape(F.col("body"))
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&n;")), F.lit("\n"))
    turns = placed.select(
        "conv_id", "window", "at", (F.col("own") < F.col("window")).alias("repeated"), F.col("role"),
        F.length(head).alias("head_len"), F.length(text).alias("text_len"), F.concat(head, text, F.lit(END + "\n")).alias("part"),
    )
    turns = turns.withColumn("part_len", F.col("head_len") + F.col("text_len") + len(END) + 1)
    inside = Window.partitionBy("conv_id", "window").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("part_len").over(inside), F.lit(0)) + F.col("head_len")
    target = (F.col("role") == "assistant") & ~F.col("repeated")
    turns = turns.withColumn("mask", F.when(target, F.struct(start.alias("start"), (start + F.col("text_len")).alias("end"))))
    grouped = turns.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("at", "part", "mask"))).alias("turns"), F.sum(F.col("repeated").cast("int")).alias("n_context")
    )
    return grouped.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("text"),
        F.col("n_context").cast("int").alias("n_context"),
        F.array_compact(F.transform("turns", lambda t: t["mask"])).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars), from the windows' texts and masks.

    ``turns`` is role, newline, text, newline of each turn; repeated turns are left out.
    """
    parts = F.split("text", r"<\|end\|>\n")
    own = F.slice(parts, F.col("n_context") + 1, F.size(parts) - F.col("n_context") - 1)
    bare = F.transform(own, lambda p: F.substr(p, F.lit(len(TURN) + 1)))
    plain = F.transform(
        bare,
        lambda p: F.concat(
            unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("&n;"), F.lit("\n"))),
            F.lit("\n"),
            unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)),
            F.lit("\n"),
        ),
    )
    learnt = F.transform("loss", lambda m: F.substr(F.col("text"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))
    read = formatted.select(
        "conv_id", "window", F.size(own).cast("long").alias("n"), F.array_join(plain, "").alias("plain"),
        unescape(F.array_join(learnt, "")).alias("learnt"), F.length("text").cast("long").alias("chars"),
    )
    grouped = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "plain", "learnt"))).alias("all"),
    )
    return grouped.select(
        "conv_id", "n_turns",
        F.array_join(F.transform("all", lambda w: w["plain"]), "").alias("turns"),
        F.array_join(F.transform("all", lambda w: w["learnt"]), "").alias("loss_text"),
        "formatted_chars",
    )
