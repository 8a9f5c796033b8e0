r"""Chat formatting with a grammar round trip (native: DataFrame functions alone).

Grammar of a rendered conversation::

    conversation = { turn }
    turn         = "### " role ": " body " </turn>" newline
    body         = any text without "</turn>" and without "### "

Rendering goes by rounds. Round 0 writes every text as it is. The deterministic parser reads the result back; a turn
whose text breaks the grammar, or comes back changed, is rendered again in round 1 with its control strings escaped: the
run of backslashes inside ``<\*/turn>`` and before ``### `` grows by one (in a role also between ``:`` and a space).
The parser takes one from each such run of one or more, so escaping has an exact inverse, and text without control
strings is its own escape. What still differs after the last round raises an error instead of leaving a wrong file.

The loss mask is a list of (start, length) spans in code points of the rendered text: the bodies of assistant turns.

Defined results: null text and null role count as empty; turns are ordered by turn (null first), then role, then text, so
repeated rows and ties have one order; rows with a null conv_id form one conversation; a conversation is one result row and
so fits in one task by definition; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
ROUNDS = 2
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)/turn>", r"<$1\\/turn>"), r"(\\*)### ", r"\\$1### ")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\(\\*)### ", "$1### "), r"<\\(\\*)/turn>", "<$1/turn>")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r":(\\*) ", r":$1\\ ")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r":\\(\\*) ", ":$1 "))


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role) if escaped else role, F.lit(SEP), escape(text) if escaped else text, F.lit(CLOSE))


def parse_turn(turn: Column) -> Column:
    """struct(ok, role, text, at, n): at and n are the body's place in the turn, in code points."""
    inner = F.substring(turn, F.lit(len(OPEN) + 1), F.length(turn) - len(OPEN) - len(CLOSE))
    cut = F.locate(SEP, inner)
    role, body = F.substring(inner, F.lit(1), cut - 1), F.substring(inner, cut + len(SEP), F.length(inner))
    ok = turn.startswith(OPEN) & turn.endswith(CLOSE) & (cut > 0) & ~F.contains(inner, F.lit("</turn>")) & ~inner.rlike(r"(?<!\\)### ")
    return F.struct(ok.alias("ok"), unescape_role(role).alias("role"), unescape(body).alias("text"), (cut + len(SEP) + len(OPEN) - 1).alias("at"), F.length(body).alias("n"))


def _round_trips(turn: Column, role: Column, text: Column) -> Column:
    p = parse_turn(turn)
    return p["ok"] & (p["role"] == role) & (p["text"] == text)


def render_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: __cf_conv, __cf_turn, role, text, rendered, round."""
    t = rows.select(F.col(conv_col).alias("__cf_conv"), F.col(turn_col).alias("__cf_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    tries = [render_turn(role, text, k > 0) for k in range(ROUNDS)]
    at = F.coalesce(*[F.when(_round_trips(x, role, text), F.lit(k)) for k, x in enumerate(tries)], F.raise_error(F.lit("a turn does not survive the round trip")).cast("int"))
    return t.withColumn("round", at).withColumn("rendered", F.when(F.col("round") == 0, tries[0]).otherwise(tries[1]))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length), rounds. The grouping moves each text once."""
    t = render_turns(rows, conv_col, turn_col, role_col, text_col)
    # Where each turn starts is a running sum in the order of the turns; the window and the grouping share one shuffle.
    order = Window.partitionBy("__cf_conv").orderBy("__cf_turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = t.withColumn("start", F.coalesce(F.sum(F.length("rendered").cast("long")).over(order), F.lit(0))).withColumn("body", parse_turn(F.col("rendered")))
    piece = F.struct("start", "rendered", "round", (F.col("role") == LOSS_ROLE).alias("on"), (F.col("start") + F.col("body.at")).cast("int").alias("at"), F.col("body.n").alias("n"))
    g = placed.groupBy("__cf_conv").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda x: x["rendered"]), "")
    spans = F.transform(F.filter("turns", lambda x: x["on"]), lambda x: F.struct(x["at"].alias("start"), x["n"].alias("length")))
    return g.select(F.col("__cf_conv").alias("conv_id"), formatted.alias("formatted"), spans.alias("loss_spans"), F.array_max(F.transform("turns", lambda x: x["round"])).alias("rounds"))


def parse_formatted(formatted: Column) -> Column:
    """array<struct(ok, role, text, at, n)> of a rendered conversation."""
    pieces = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: parse_turn(F.concat(x, F.lit(CLOSE))))


def read_back(out: DataFrame) -> DataFrame:
    """What the formatted text and its mask say, parsed again: the digests of the query."""
    p = out.withColumn("__cf_turns", parse_formatted(F.col("formatted"))).withColumn(
        "__cf_loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    )
    told = F.array_join(F.transform("__cf_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return p.select(
        "conv_id",
        F.size("__cf_turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("__cf_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__cf_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
