"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are marked as `<|im_start|>role`, a line feed, the text and `<|im_end|>` with a line feed. A text
may hold such marks itself: in texts and roles every `<|`, with any number of
backslashes between the two characters, gets one backslash more, which reading back
takes away. Line feeds and backslashes of roles are escaped too.

Prefix sums of the turns' sizes choose the windows; a size is the formatted turn's bytes,
which bounds its tokens from above. What a budget leaves beside the
system turn and the history is a stride: a turn that lies inside one stride of the
prefix sums joins that stride's window, a turn that reaches into the next has a window
of its own, so that windows hold whole turns in order and stay within the budget unless
one turn alone is above it or the system turn takes more than half of it. A window repeats the conversation's first system turn, if
that came before, and at most HISTORY turns before its own within their part of the
budget. Repeated turns are outside the loss mask; the texts of the window's own
assistant turns are inside.

Defined results: null texts and roles are empty; turns with equal numbers are ordered
by role and text, repeated rows are turns each; null turn numbers come first; null is a
conversation id like others; no rows give no windows; a text longer than the budget is a
window of its own with its context, whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Bytes of a window. A token of any vocabulary over bytes has one at least, so a window has no more tokens than that; about a fourth of it is usual.
BUDGET = 4096
#: Turns repeated before a window's own, and their share of the budget.
HISTORY = 2
HISTORY_SHARE = 0.25


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    # between doubled backslashes, a single one and n are a line feed
    parts = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def total(i: Column) -> Column:
    """Bytes of the turns before, up to the i-th."""
    return F.aggregate(F.slice("_before", 1, i + 1), F.lit(0), lambda s, x: s + F.coalesce(x["_n"], F.lit(0)))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_context (repeated turns in front), n_turns (own), size (bytes) and loss.

    loss is an array of (start, length) in characters of formatted, start from 0.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("_head"), escaped(F.col("text")).alias("_body"),
    )
    t = t.withColumn("_piece", F.concat("_head", "_body", F.lit(f"{END}\n"))).withColumn("_n", F.octet_length("_piece")).withColumn("_seq", F.row_number().over(order)).withColumn("_end", F.sum("_n").over(so_far))
    system = F.first(F.when(F.col("role") == "system", F.struct("_seq", "_piece", "_n")), ignorenulls=True)
    t = t.withColumn("_system", system.over(so_far))
    size = F.first(F.when(F.col("role") == "system", F.col("_n")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    past = int(budget * HISTORY_SHARE)
    t = t.withColumn("_stride", F.greatest(F.lit(budget - past) - F.coalesce(size, F.lit(0)), F.lit(budget // 4)))
    cell = F.expr("(_end - _n) div _stride")
    t = t.withColumn("window", 2 * cell + (F.col("_end") > (cell + 1) * F.col("_stride")).cast("long"))
    # the turns before a window's first one, while they fit
    before = [F.lag(F.struct("_seq", "_piece", "_n"), k).over(order) for k in range(1, history + 1)]
    t = t.withColumn("_before", F.array(*before)).withColumn("_opens", ~F.lag("window").over(order).eqNullSafe(F.col("window")))
    earlier = F.col("_system").isNotNull() & (F.col("_system._seq") < F.col("_seq"))
    repeated = F.filter("_before", lambda x, i: x.isNotNull() & ~x["_seq"].eqNullSafe(F.col("_system._seq")) & (total(i) <= past))
    context = F.concat(F.filter(F.array("_system"), lambda _: earlier), F.reverse(repeated))
    t = t.withColumn("_context", F.when(F.col("_opens") & (F.col("_seq") > 1), context)).drop("_before", "_system")
    within = W.partitionBy("conv_id", "window").orderBy("_seq")
    front = F.array_join(F.transform("_context", lambda x: x["_piece"]), "")
    t = t.withColumn("_front", F.coalesce(F.when(F.col("_opens"), front), F.lit("")))
    shift = F.sum(F.length("_front") + F.length("_piece")).over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.length("_piece")
    t = t.withColumn("_at", shift + F.length("_head"))
    turns = F.sort_array(F.collect_list(F.struct("_seq", "_piece", "_at", F.length("_body").alias("_chars"), (F.col("role") == "assistant").alias("_loss"))))
    grouped = t.groupBy("conv_id", "window").agg(
        turns.alias("_turns"), F.max("_front").alias("_front"), F.max(F.coalesce(F.size("_context"), F.lit(0))).alias("n_context"),
        F.sum(F.col("_n") + F.coalesce(F.aggregate("_context", F.lit(0), lambda s, x: s + x["_n"]), F.lit(0))).alias("size"),
    )
    return grouped.select(
        "conv_id", "window",
        F.concat("_front", F.array_join(F.transform("_turns", lambda x: x["_piece"]), "")).alias("formatted"),
        F.greatest("n_context", F.lit(0)).alias("n_context"), F.size("_turns").alias("n_turns"), "size",
        F.transform(F.filter("_turns", lambda x: x["_loss"]), lambda x: F.struct(x["_at"].alias("start"), x["_chars"].alias("length"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the window's own turns) and loss_texts, from the formatted text and the mask."""
    marked = F.slice(F.split("formatted", r"<\|im_start\|>"), F.col("n_context") + 2, F.greatest("n_turns", F.lit(1)))
    body = lambda x: F.substr(x, F.locate("\n", x) + 1, F.length(x) - F.locate("\n", x) - len(END) - 1)
    turn = lambda x: F.struct(unescaped_role(F.substring_index(x, "\n", 1)).alias("role"), unescaped(body(x)).alias("text"))
    masked = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "window", F.transform(marked, turn).alias("turns"), masked.alias("loss_texts"), F.length("formatted").alias("chars"))


def report(conversations: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its windows."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    text = F.lit(f"{END}{START}assistant ok")
    kinds = dict(rows.dtypes)
    own = rows.sparkSession.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text")
    )
    parts = read_back(windows(rows.unionByName(own)))
    texts = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    each = parts.select("conv_id", F.struct("window", texts.alias("all"), F.array_join("loss_texts", "").alias("loss")).alias("w"), F.size("turns").alias("n"), "chars")
    found = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda part: F.array_join(F.transform("w", lambda x: x[part]), "")
    loss = joined("loss")
    return found.select(
        "conv_id", "n_turns", F.sha2(joined("all").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
