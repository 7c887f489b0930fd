"""Chat formatting in budgeted, turn-aligned windows, in DataFrame expressions only.

The tokens of a conversation's turns are summed up in order, and the sums cut it into windows: a
turn belongs to the cell of the budget in which it lies, and a turn across two cells is a window
of its own. A window repeats the system turn and, up to a budget, the turns before it; what it
repeats is context and not a target. The loss mask covers the texts of the assistant turns that
are new in the window, so each is a target exactly once.

Turns are marked `<turn role>` ... `</turn>`. In texts and roles a backslash is written `\\s`, `<`
`\\l` and `>` `\\g`, so no text can imitate a mark and every text can be read back.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrowatch.llm.common import quoted

# The template.
OPEN, CLOSE = "<turn {}>\n", "</turn>\n"
TURN = r"<turn ([^<>]*)>\n([^<]*)</turn>\n"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))
CHARS_PER_TOKEN = 4
BUDGET = 1024
HISTORY = 256


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _opening(role: Column) -> Column:
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), escaped(role), F.lit(after))


def _piece(turn: Column) -> Column:
    return F.concat(_opening(turn["role"]), escaped(turn["text"]), F.lit(CLOSE))


def format_chat(
    conversations: DataFrame,
    *,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, window, n_turns, n_repeated, formatted, loss): the windows of each conversation.

    loss lists (start, length) in code points of formatted; n_repeated turns come first in a
    window. System turn, history and new turns of a window stay within the budget of estimated
    tokens, unless the system turn and a single turn exceed it: turns are never cut. A null text
    or role is empty; rows with a null conv_id are one conversation; turns are ordered by number
    (null first), then role, then text, and repeated rows are repeated turns. Other columns are
    not read. An empty table has no windows.
    """
    turns = conversations.select(
        F.col(quoted(conv_id)).alias("conv"),
        F.col(quoted(turn)).alias("number"),
        F.coalesce(F.col(quoted(role)).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
    )
    conv = Window.partitionBy("conv")
    # The row's place makes the order total, so that every window below sees the same one.
    ordered = conv.orderBy("number", "role", "text")
    turns = turns.withColumn("place", F.row_number().over(ordered))
    in_order = conv.orderBy("place")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = (F.col("place") == 1) & (F.col("role") == "system")
    estimate = F.greatest(F.ceil(F.char_length("text") / CHARS_PER_TOKEN), F.lit(1)).cast("long")
    turns = turns.withColumn("head", heads).withColumn("tokens", estimate)
    system = F.when(F.col("head"), F.struct("role", "text", "tokens"))
    turns = turns.withColumn("system", F.first(system, ignorenulls=True).over(upto))
    own = F.when(F.col("head"), 0).otherwise(F.col("tokens"))
    taken = F.coalesce("system.tokens", F.lit(0))
    room = F.greatest(F.lit(budget - history) - taken, F.lit(1))
    turns = turns.withColumn("end", F.sum(own).over(upto))
    turns = turns.withColumn("start", F.col("end") - own).withColumn(
        "cell", F.struct(F.floor(F.col("start") / room), F.floor((F.col("end") - 1) / room))
    )
    # The head takes no room; it stays with the first window, also where it is the only turn.
    body = turns.withColumn("cell", F.when(~F.col("head"), F.col("cell")))
    previous = F.lag("cell").over(in_order)
    opens = ~F.col("head") & (previous.isNull() | (previous != F.col("cell")))
    body = body.withColumn("opens", opens)
    opened = F.sum(F.col("opens").cast("long")).over(upto)
    body = body.withColumn("window", F.greatest(opened, F.lit(1)))
    # What stands at most `history` tokens before a window; the frame is as short as that.
    reach = conv.orderBy("start").rangeBetween(-history, Window.currentRow)
    nearby = F.collect_list(F.when(~F.col("head"), F.struct("place", "role", "text"))).over(reach)
    body = body.withColumn("nearby", nearby)
    earlier = F.filter("nearby", lambda t: t["place"] < F.col("place"))
    windows = body.groupBy("conv", "window").agg(
        F.sort_array(
            F.collect_list(F.when(~F.col("head"), F.struct("place", "role", "text")))
        ).alias("new"),
        F.first(F.when(F.col("opens"), earlier), ignorenulls=True).alias("before"),
        F.first(F.col("system"), ignorenulls=True).alias("system"),
    )

    def marked(turn: Column, repeated: Column) -> Column:
        return F.struct(
            turn["role"].alias("role"), turn["text"].alias("text"), repeated.alias("repeated")
        )

    first = F.col("window") == 1
    none = F.filter(F.array(marked(F.col("system"), F.lit(True))), lambda t: F.lit(False))
    leading = F.array(marked(F.col("system"), ~first))
    parts = F.concat(
        F.when(F.col("system").isNotNull(), leading).otherwise(none),
        F.transform(F.coalesce("before", F.slice("new", 1, 0)), lambda t: marked(t, F.lit(True))),
        F.transform("new", lambda t: marked(t, F.lit(False))),
    )
    windows = windows.select("conv", "window", parts.alias("parts"))
    target = lambda t: ~t["repeated"] & (t["role"] == "assistant")
    nowhere = F.expr("struct(0 AS place, array_repeat(struct(0 AS start, 0 AS length), 0) AS loss)")

    def mask(state: Column, t: Column) -> Column:
        at = state["place"] + F.char_length(_opening(t["role"]))
        length = F.char_length(escaped(t["text"]))
        span = F.array(F.struct(at.alias("start"), length.alias("length")))
        return F.struct(
            (at + length + len(CLOSE)).alias("place"),
            F.when(target(t), F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"),
        )

    return windows.select(
        F.col("conv").alias(conv_id),
        "window",
        F.size("parts").alias("n_turns"),
        F.size(F.filter("parts", lambda t: t["repeated"])).alias("n_repeated"),
        F.array_join(F.transform("parts", _piece), "").alias("formatted"),
        F.aggregate("parts", nowhere, mask)["loss"].alias("loss"),
    )


def read_windows(windows: DataFrame, *, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, window, n_chars, turns, targets): the new turns and the texts under the loss mask, as they
    were before formatting, read from the formatted text alone."""
    text = F.col("formatted")
    parsed = F.zip_with(
        F.regexp_extract_all(text, F.lit(TURN), F.lit(1)),
        F.regexp_extract_all(text, F.lit(TURN), F.lit(2)),
        lambda role, body: F.struct(unescaped(role).alias("role"), unescaped(body).alias("text")),
    )
    new = F.slice(parsed, F.col("n_repeated") + 1, F.greatest(F.size(parsed), F.lit(1)))
    masked = F.transform(
        "loss", lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))
    )
    return windows.select(
        F.col(quoted(conv_id)),
        "window",
        F.char_length("formatted").alias("n_chars"),
        new.alias("turns"),
        masked.alias("targets"),
    )
