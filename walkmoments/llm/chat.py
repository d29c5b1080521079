r"""Chat formatting (operator 2, native): budgeted windows.

Turns are escaped, marked and cut into windows of whole turns. Each window starts with the
conversation's system turn (from the window after its own on) and repeats the last turns of the
window before it. A conversation of at most ``budget`` tokens is one window. Else prefix sums of turn
tokens choose the windows: ``room`` is what the system turn leaves of the budget, ``cap`` the greater of
``room - history`` and half of ``room``. A turn of more than half of ``cap`` is a window of its own; the
others belong to span ``floor(tokens before / (cap / 2))``, so the turns of a span hold no more than
``cap``. A window repeats as many of the turns just before it as fit ``history`` and what its own turns
leave of ``room``. So no window exceeds the budget but those whose one own turn, with the system
turn, does: a turn is never cut, and the system turn never left out. Assistant texts are targets in
their own window only: repeats are masked.

Template: ``<turn role>`` line feed, text, ``</turn>`` line feed. Inside roles and texts the
control strings are replaced so that no marker can be forged, and reversibly: a backslash becomes
``\b``, ``</turn>`` becomes ``\e``, ``<turn `` becomes ``\s`` and, in roles, ``>`` becomes ``\g``
and a line feed ``\n``. Tokens are counted on the marked, escaped turn: one for each four code points
begun.

Prefix sums run over blocks of 64 turn numbers, windows are numbered over blocks of spans, and texts
meet their windows by (conversation, block) and (conversation, span): a conversation with very many
turns is not sorted in one task. Joins by conversation alone carry the one system turn, or numbers.

Defined results: a null text or role is empty; a null conv_id is a conversation of its own; turns
are ordered by turn (null first), role and text, so repeated rows follow each other; an empty table
gives an empty table; only the first system turn is retained, and where several turns are marked
system the others are ordinary turns. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_prefix, materialize, text_or_empty

BUDGET, HISTORY = 2048, 512
BLOCK_BITS = 6
OPEN, CLOSE = "<turn ", "</turn>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for plain, code in ((CLOSE, "\\e"), (OPEN, "\\s"), *(((">", "\\g"), ("\n", "\\n")) if role else ())):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column, role: bool = False) -> Column:
    out = text
    for plain, code in ((CLOSE, "\\e"), (OPEN, "\\s"), *(((">", "\\g"), ("\n", "\\n")) if role else ())):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """__c_key, __c_turn, __c_role, __c_text, __c_head, __c_marked, __c_tokens of every row; the key is never null."""
    text, role = text_or_empty("text"), text_or_empty("role")
    head = F.concat(F.lit(OPEN), escape(role, True), F.lit(">\n"))
    marked = F.concat(head, escape(text), F.lit(CLOSE + "\n"))
    return conversations.select(
        "conv_id",
        F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("__c_key"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("__c_turn"),
        role.alias("__c_role"),
        text.alias("__c_text"),
        F.length(head).alias("__c_head"),
        marked.alias("__c_marked"),
        F.ceil(F.length(marked) / 4.0).cast("long").alias("__c_tokens"),
    )


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_context, targets, n_tokens.

    ``formatted`` begins with ``n_context`` masked turns (the retained system turn, then repeated
    ones); ``targets`` lists the code point spans (start, end exclusive) of ``formatted`` under the
    loss mask: the texts of the window's own assistant turns.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be at least 0 and less than the budget")
    zero, key = F.lit(0).cast("long"), "__c_key"
    raw = turns_of(conversations).withColumn("__b", F.shiftright(F.col("__c_turn"), BLOCK_BITS))
    # what a conversation holds in all, and its system turn's tokens, come to its blocks as numbers
    system_first = F.min(F.when(F.col("__c_role") == "system", F.struct("__c_turn", "__c_text", "__c_tokens")))
    whole = raw.groupBy(key).agg(F.sum("__c_tokens").alias("__c_all"), system_first["__c_tokens"].alias("__c_system"))
    sums = raw.groupBy(key, "__b").agg(F.sum("__c_tokens").alias("__s"))
    earlier = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.withColumn("__c_base", F.coalesce(F.sum("__s").over(earlier), zero)).drop("__s").join(whole, key)
    in_block = Window.partitionBy(key, "__b").orderBy("__c_turn", "__c_role", "__c_text").rowsBetween(Window.unboundedPreceding, -1)
    turns = raw.withColumn("__w", F.coalesce(F.sum("__c_tokens").over(in_block), zero)).join(blocks, [key, "__b"])
    before, tokens = F.col("__c_base") + F.col("__w"), F.col("__c_tokens")
    turns = turns.withColumn("__c_before", before).withColumn("__c_room", F.lit(budget) - F.coalesce("__c_system", zero))
    half = F.greatest(F.floor(F.greatest(F.col("__c_room") - history, F.floor(F.col("__c_room") / 2)) / 2), F.lit(1)).cast("long")
    one = F.col("__c_all") <= budget
    turns = turns.withColumn("__c_big", ~one & (tokens > half)).withColumn("__c_span", F.when(one, zero).otherwise(F.floor(F.col("__c_before") / half)).cast("long"))
    # written once, as the plan below reads them again and again
    turns = materialize(turns.select("conv_id", key, "__c_span", "__c_big", "__c_before", "__c_room", "__c_tokens", "__c_role", "__c_head", "__c_marked"), "chat-turns")
    place = [key, "__c_span", "__c_big"]
    spans = turns.groupBy("conv_id", *place).agg(F.min("__c_before").alias("__c_start"), F.sum("__c_tokens").alias("__c_own"), F.first("__c_room").alias("__c_room"))
    spans = spans.withColumn("__c_one", F.lit(1).cast("long"))
    spans = block_prefix(spans, [key], F.shiftright("__c_span", 2 * BLOCK_BITS), [F.col("__c_span"), F.col("__c_big")], "__c_one", "window").drop("__c_one")
    spans = materialize(spans, "chat-spans")
    first = turns.filter("__c_role = 'system'").groupBy(key).agg(F.min(F.struct("__c_before", "__c_role", "__c_head", "__c_marked")).alias("__c_first"))
    first = first.select(key, F.col("__c_first.__c_before").alias("__c_at"), *[F.col(f"__c_first.{c}").alias(c) for c in ("__c_role", "__c_head", "__c_marked")])
    # what the next window takes of this one's last turns, and where the system turn lies: numbers
    after = spans.select(key, (F.col("window") - 1).alias("window"), F.least(F.lit(history), F.col("__c_room") - F.col("__c_own")).alias("__c_takes"))
    known = spans.drop("conv_id", "__c_room").join(after, [key, "window"], "left").join(first.select(key, "__c_at"), key, "left")
    placed = turns.drop("__c_room").join(known, place)
    near = (F.col("__c_start") + F.col("__c_own") - F.col("__c_before") <= F.col("__c_takes")) & ~F.col("__c_before").eqNullSafe(F.col("__c_at"))
    seen = F.array(F.struct("window", F.lit(2).alias("part")), F.when(near, F.struct((F.col("window") + 1).alias("window"), F.lit(1).alias("part"))))
    said = ["conv_id", key, "__c_before", "__c_role", "__c_head", "__c_marked"]
    turn = placed.select(*said, F.explode(F.filter(seen, lambda x: x.isNotNull())).alias("__c_in")).select(*said, F.col("__c_in.window").alias("window"), F.col("__c_in.part").alias("__c_part"))
    system = spans.select("conv_id", key, "window", "__c_start").join(first, key).filter(F.col("__c_start") > F.col("__c_at"))
    system = system.withColumn("__c_before", F.col("__c_at")).select(*said, "window", F.lit(0).alias("__c_part"))
    parts = turn.unionByName(system).select(
        "conv_id",
        key,
        "window",
        F.struct(
            F.col("__c_part").alias("part"),
            F.col("__c_before").alias("before"),
            F.col("__c_marked").alias("marked"),
            F.col("__c_head").alias("head"),
            ((F.col("__c_role") == "assistant") & (F.col("__c_part") == 2)).alias("target"),
        ).alias("__c_piece"),
    )
    windows = parts.groupBy("conv_id", "__c_key", "window").agg(F.sort_array(F.collect_list("__c_piece")).alias("__c_pieces"))
    tail = len(CLOSE) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["marked"])
        span = F.struct((acc["at"] + p["head"]).alias("start"), (end - tail).alias("end"))
        return F.struct(end.alias("at"), F.when(p["target"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pieces = F.col("__c_pieces")
    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform(pieces, lambda p: p["marked"]), "").alias("formatted"),
        F.size(F.filter(pieces, lambda p: p["part"] < 2)).alias("n_context"),
        F.aggregate(pieces, start, step, lambda acc: acc["out"]).alias("targets"),
        F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + F.ceil(F.length(p["marked"]) / 4.0)).alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text of the window's own turns) and loss (array of target texts)."""
    ended = F.filter(F.split("formatted", CLOSE + "\n"), lambda x: x != "")
    own = F.slice(ended, F.col("n_context") + 1, F.size(ended))

    def parse(x: Column) -> Column:
        halves = F.split(x, ">\n", 2)
        role = F.substring(F.get(halves, F.lit(0)), len(OPEN) + 1, F.length(x))
        return F.struct(unescape(role, True).alias("role"), unescape(F.get(halves, F.lit(1))).alias("text"))

    target = F.transform("targets", lambda t: unescape(F.substring(F.col("formatted"), t["start"] + 1, t["end"] - t["start"])))
    return windows.select("conv_id", "window", "formatted", F.transform(own, parse).alias("turns"), target.alias("loss"))


def digests(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, from the formatted windows.

    A digest is of a whole conversation, so its windows meet in one row here, and only here.
    """
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    one = read_back(format_windows(conversations, budget, history)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
        F.struct("window", turns.alias("turns"), F.array_join("loss", "").alias("loss")).alias("w"),
    )
    whole = one.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.sort_array(F.collect_list("w")).alias("ws")
    )
    said, loss = F.array_join("ws.turns", ""), F.array_join("ws.loss", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
