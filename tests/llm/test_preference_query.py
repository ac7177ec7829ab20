"""Pairs of the preference query share real prompts."""

from __future__ import annotations

from conftest import got
from pyspark.sql import functions as F

from tagspark.llm import preferences
from tagspark.llm.queries import QUERIES, preference_sessions

TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_every_pair_has_its_prompt(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op5_chat_formatting"](spark, folder).cache()
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    first = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"), F.lit(1).alias("one"))
    longer = turns.join(first, "conv_id").where("turn < last").select("conv_id").distinct().count()
    assert longer > 50 and found.where("part = 'prompt'").select("pair_id").distinct().count() >= longer
    assert found.where("part = 'rejected' AND role <> 'assistant'").count() == 0


def test_prompts_of_one_five_and_all_turns(spark):
    rows = []
    for conv, n in ((1, 1), (2, 5), (3, 5)):
        rows += [(conv, k, "user" if k % 2 == 0 else "system", f"t{k}") for k in range(n)]
        rows += [(conv, n, "assistant", "same" if conv > 1 else "own"), (conv, n + 1, "user", "after the answer")]
    rows += [(4, 0, "assistant", "other"), (9, 0, "user", "no answer"), (None, 0, "assistant", "x"), (1, None, "assistant", "x")]
    df = spark.createDataFrame(rows, TURNS)
    found = preferences.preference_segments(*preference_sessions(df))
    counted = {tuple(r) for r in found.groupBy("pair_id", "part").count().collect()}
    assert {c for c in counted if c[0] < 4} == {
        (1, "prompt", 1), (1, "chosen", 1), (1, "rejected", 1),
        (2, "prompt", 6),
        (3, "prompt", 5), (3, "chosen", 1), (3, "rejected", 1),
    }
    assert got(found.where("part = 'rejected'"), "pair_id", "seq", "role")[:2] == [(1, 1, "assistant"), (3, 5, "assistant")]
