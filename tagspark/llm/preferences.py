"""Preference pairs from tagging sessions: a shared prompt and two masked completions.

Two sessions are compared turn by turn. The turns that both begin with are the prompt, which is
rendered once; what follows in the chosen and in the rejected session are the two completions.
Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.operators.ordered import range_totals

PROMPT, CHOSEN, REJECTED = "prompt", "chosen", "rejected"
TRAINED_ROLE = "assistant"
TURN_END = "<|end|>"


def render_turn(role: Column, text: Column) -> tuple[Column, Column]:
    """Head and body of a turn as written; nulls are empty."""
    head = F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))
    return head, F.concat(F.coalesce(text, F.lit("")), F.lit(TURN_END + "\n"))


def preference_segments(session_turns: DataFrame, session_pairs: DataFrame) -> DataFrame:
    """The turns of each pair of sessions as segments of a prompt and two completions.

    `session_turns` has session_id, seq, role and text; `session_pairs` has pair_id,
    chosen_session and rejected_session. Returns per turn: pair_id, part (prompt, chosen or
    rejected), seq, role, rendered, start (code points of its part before it), n_chars, and
    loss_start and loss_end, the code points of its part that a model is trained on: body and end
    mark of the turns that the assistant takes in a completion, null for all others. Joining the
    rendered segments of a part by `start` gives its text.

    The prompt is the longest run of first turns that are alike in seq, role and text; sessions
    that are alike have only a prompt, and a session without turns leaves the other one whole. A
    turn without seq stands after all others. Several turns with one seq are one step: they are
    alike if all are, and stand in the order of role and text. Repeated rows count once, a null
    role or text is empty, but not alike to an empty one. Turns of sessions in no pair, pairs
    without id and turns without session are left out. Empty tables give no rows, and further
    columns are ignored.

    A session is never gathered: turns are compared per step, and offsets are running totals over
    ranges, so one session may hold most turns.
    """
    sides = session_pairs.where("pair_id is not null").select(
        "pair_id",
        F.inline(
            F.array(
                F.struct(F.lit(CHOSEN).alias("side"), F.col("chosen_session").alias("session_id")),
                F.struct(F.lit(REJECTED).alias("side"), F.col("rejected_session").alias("session_id")),
            )
        ),
    ).distinct()
    turns = session_turns.select("session_id", "seq", "role", "text").distinct().join(sides, "session_id")
    turns = turns.withColumn("step", F.struct(F.col("seq").isNull().alias("late"), "seq"))

    def of(side: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("role", "text"))))

    steps = turns.groupBy("pair_id", "step").agg(of(CHOSEN).alias("c"), of(REJECTED).alias("r"))
    apart = steps.where("c <> r").groupBy("pair_id").agg(F.min("step").alias("apart"))
    placed = turns.join(apart, "pair_id", "left").withColumn(
        "part", F.when(F.col("apart").isNull() | (F.col("step") < F.col("apart")), F.lit(PROMPT)).otherwise(F.col("side"))
    )
    once = placed.where((F.col("part") != PROMPT) | (F.col("side") == CHOSEN))

    head, body = render_turn(F.col("role"), F.col("text"))
    rendered = once.select(
        "pair_id",
        "part",
        F.col("step.late").alias("late"),
        "seq",
        "role",
        "text",
        F.concat(head, body).alias("rendered"),
        F.length(head).cast("bigint").alias("head"),
    ).withColumn("n_chars", F.length("rendered").cast("bigint"))
    order = ["late", "seq", "role", "text"]
    along = range_totals(rendered, order, {"upto": F.col("n_chars")}, group=["pair_id", "part"])
    trained = (F.col("part") != PROMPT) & F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False))
    start = F.col("upto") - F.col("n_chars")
    return along.select(
        "pair_id",
        "part",
        "seq",
        "role",
        "rendered",
        start.alias("start"),
        "n_chars",
        F.when(trained, start + F.col("head")).alias("loss_start"),
        F.when(trained, F.col("upto")).alias("loss_end"),
    )
