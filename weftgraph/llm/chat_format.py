"""Preference formatting: paired, masked completions after a prompt rendered once.

DataFrame functions only. Both conversations of a pair are arrays of turns; the prompt is their
longest common turn prefix, the completions are what follows on either side. Each completion
comes with its loss spans: [start, end) code points of assistant texts, the end mark included.

Turns are ordered by (turn, role, text); nulls first. A null role reads ``unknown``, a null text is
empty; turns are equal if role and text are, null-safe. A conversation missing on one side is
empty: prompt and that completion are empty texts. Rows with a null conversation id belong to no
conversation: each is one of its own, so they never meet in one task. Repeated rows are repeated
turns. An empty table gives no rows. The row of a pair is as long as its conversations are; nothing
else is gathered. Extra columns are ignored; a text of any length is kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<turn:bigint,role:string,text:string>"


def gather(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): one row a conversation, and one for each row with a null conversation id."""
    item = F.struct(F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = turns.select(F.col(conv).alias("conv_id"), item.alias("item"))
    lone = rows.where("conv_id is null").select("conv_id", F.array("item").alias("turns"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("turns"))
    return whole.unionByName(lone)


def _piece(x: Column) -> Column:
    """A turn as text, and where in it the loss counts."""
    head = F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("unknown")), F.lit("|>\n"))
    body = F.concat(F.coalesce(x["text"], F.lit("")), F.lit("<|end|>\n"))
    on = F.coalesce(x["role"] == "assistant", F.lit(False))
    return F.struct(F.concat(head, body).alias("all"), F.length(head).cast("bigint").alias("head"), F.length(body).cast("bigint").alias("body"), on.alias("on"))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda x: _piece(x)["all"]))


def _upto(pieces: Column) -> Column:
    """Ends of the pieces by doubling: each round adds what stands 1, 2, 4, ... places before, so nothing is appended to."""
    rounds = F.when(F.size(pieces) > 1, F.ceil(F.log2(F.size(pieces)))).otherwise(0).cast("int")
    steps = F.slice(F.array(*[F.lit(1 << k) for k in range(31)]), F.lit(1), rounds)

    def add(acc: Column, k: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0).cast("bigint"), k), F.slice(acc, F.lit(1), F.size(acc) - k))
        return F.zip_with(acc, moved, lambda x, y: x + y)

    return F.aggregate(steps, F.transform(pieces, lambda p: p["head"] + p["body"]), add)


def loss_spans(turns: Column) -> Column:
    """array<struct<begin, end>> of assistant texts within render(turns)."""
    span = lambda p, end: F.struct((end - p["body"]).alias("begin"), end.alias("end"), p["on"].alias("on"))

    def spans(pieces: Column) -> Column:
        own = F.filter(F.zip_with(pieces, _upto(pieces), span), lambda x: x["on"])
        return F.transform(own, lambda x: F.struct(x["begin"], x["end"]))

    return F.transform(F.array(F.transform(turns, _piece)), spans)[0]  # the pieces are made once


def spans_text(spans: str) -> Column:
    """begin:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["begin"].cast("string"), x["end"].cast("string"))))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn arrays, by role and text."""
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, (first - 1).cast("int")).otherwise(least)


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with n_common, prompt, chosen_text, chosen_loss, rejected_text, rejected_loss in place of the two turn arrays."""
    empty = F.array().cast(f"array<{TURN}>")
    cut = pairs.withColumns({chosen: F.coalesce(F.col(chosen), empty), rejected: F.coalesce(F.col(rejected), empty)})
    cut = cut.withColumn("n_common", common_turns(F.col(chosen), F.col(rejected)))
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    return cut.withColumns(
        {
            "prompt": render(F.slice(F.col(chosen), F.lit(1), F.col("n_common"))),
            "chosen_text": render(rest(chosen)),
            "chosen_loss": loss_spans(rest(chosen)),
            "rejected_text": render(rest(rejected)),
            "rejected_loss": loss_spans(rest(rejected)),
        }
    ).drop(chosen, rejected)


def swap_last_answer(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: (conv_id, chosen, rejected).

    Rejected is the conversation with its last assistant turn answered as the partner's last
    assistant turn (partner: conv_id with its lowest bit flipped); without a partner's answer that
    turn is left out. A conversation without an assistant turn has itself on both sides.
    """
    own = F.filter("turns", lambda x: F.coalesce(x["role"] == "assistant", F.lit(False)))
    answer = F.element_at(own, -1)["text"]
    base = conversations.withColumns({"partner": F.col("conv_id").bitwiseXOR(F.lit(1)), "answered": F.size(own) > 0})
    last = F.when(F.col("answered"), F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda x: F.coalesce(x["role"] == "assistant", F.lit(False)))), True).cast("int") + 1)
    other = conversations.where(F.size(own) > 0).select(F.col("conv_id").alias("partner"), F.struct(answer.alias("text")).alias("other"))
    joined = base.withColumn("last", last).join(other, "partner", "left")
    before, after = F.slice("turns", F.lit(1), F.col("last") - 1), F.slice("turns", F.col("last") + 1, F.size("turns"))
    turn = F.element_at("turns", F.col("last"))
    new = F.when(F.col("other").isNotNull(), F.array(F.struct(turn["turn"].alias("turn"), turn["role"].alias("role"), F.col("other.text").alias("text")))).otherwise(F.array().cast(f"array<{TURN}>"))
    rejected = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.concat(before, new, after))
    return joined.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))
