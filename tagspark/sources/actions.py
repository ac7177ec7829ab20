"""Write actions as files: one JSON request body per action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def action_body() -> Column:
    """JSON of one action: key "0" adds, key "1" removes, an empty list is left out."""
    changes = F.struct(F.col("add_tags").alias("0"), F.col("remove_tags").alias("1"))
    return F.to_json(
        F.struct(
            F.array("hash").alias("hashes"),
            F.create_map("service_key", changes).alias("service_keys_to_actions_to_tags"),
        )
    )


def write_tag_actions(actions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    actions.select(action_body().alias("value")).write.mode(mode).text(path)
