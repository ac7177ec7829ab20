from __future__ import annotations

import random

import pytest

# Extra columns that bear names the operators use inside.
SCHEMA = "file_id bigint, tag_text string, service_key string, row bigint, key string, level int, size string, host string, n int"


def files(spark, *rows):
    """(file_id, tag_text, service_key) rows with clashing further columns."""
    return spark.createDataFrame([(*r, 7, "k", 1, "s", "h", 2) for r in rows], SCHEMA)


def words(seed: int, n: int, of: int = 400) -> str:
    """Text of n words, several per line."""
    draw = random.Random(seed)
    return "".join(f"tag_{draw.randrange(of)}" + draw.choice("   \n") for _ in range(n))


@pytest.fixture(scope="session")
def odd_files(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = words(5, 60_000, 5_000)
    return files(
        spark,
        (1, "blue hair, 1girl", "svc1"),
        (1, "blue hair, 1girl", "svc1"),
        (2, "blue\thair,\n1girl ", "svc2"),
        (3, None, "svc1"),
        (4, "", None),
        (5, " \n\x0b ", "svc3"),
        (None, "solo, smile", "svc1"),
        (None, None, None),
        (6, long_text, "svc2"),
        (7, long_text + "x", "svc2"),
        (8, "Ünïcode ſ     日本 😀", "svc9"),
    )


@pytest.fixture(scope="session")
def no_files(spark):
    return files(spark, (1, "a", "b")).limit(0)
