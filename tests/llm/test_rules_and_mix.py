"""Rule ledger against brute force, policies and ablations; the mix against its targets."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import got
from pyspark.sql import functions as F

from tagspark.llm import fair_mix as M
from tagspark.llm import rule_ledger as R
from tagspark.llm.texts import tag_texts

from .conftest import files, words


def brute_measures(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures_equal_brute_force(spark, odd_files, no_files):
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abc") for _ in range(n)) for n in (0, 1, 4, 5, 6, 7, 9, 12, 30, 100)]
    texts += ["\n".join([words(1, 6)] * 4), "a b c d e a b c d e", "a a a a a a", "# * $ % & | < > x", words(4, 500), words(4, 500) * 2]
    rows = files(spark, *[(i, t, None) for i, t in enumerate(texts)]).unionByName(odd_files)
    ledger = R.rule_ledger(rows)
    found = got(ledger, "file_id", *R.MEASURES)
    assert found == sorted(((r["file_id"], *brute_measures(r["tag_text"])) for r in rows.collect()), key=repr)
    assert R.rule_ledger(no_files).collect() == [] and R.ablations(R.rule_ledger(no_files)).collect() == []
    assert got(ledger.where("n_words < 10"), "file_id") == got(ledger.where("fail_bits & 1 = 1"), "file_id")


def test_the_ledger_shuffles_nothing_and_runs_no_python(spark, odd_files):
    plan = R.apply_policy(R.rule_ledger(odd_files), "v1")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_policies_and_ablations(spark):
    bits = R.mask_of
    ledger = spark.createDataFrame(
        [(1, 0), (2, bits(("few_words",))), (3, bits(("many_symbols",))), (4, bits(("many_symbols", "few_words"))), (5, None)],
        "file_id bigint, fail_bits bigint",
    )
    policies = {"base": R.BASE, "v1": tuple(R.RULES)}
    assert got(R.apply_policy(ledger, "base", policies).where("kept"), "file_id") == [(1,), (3,)]
    assert got(R.apply_policy(ledger, "v1", policies).where("kept"), "file_id") == [(1,)]
    assert got(R.apply_policy(ledger, "v1", policies).where("base_failed"), "file_id") == [(2,), (4,), (5,)]
    table = {(r["policy"], r["rule"]): (r["failing"], r["rejected"], r["only_this_rule"]) for r in R.ablations(ledger, policies).collect()}
    assert table["v1", "few_words"] == (2, 3, 1)
    assert table["v1", "many_symbols"] == (2, 3, 1)
    assert table["base", "few_words"] == (2, 2, 2)
    assert table["v1", "repeated_lines"] == (0, 3, 0)


def filled(sizes, weights, share, most):
    """Targets by filling up in small steps of what is left."""
    budget, targets = share * sum(sizes), [0.0] * len(sizes)
    for _ in range(len(sizes) + 1):
        open_ = [i for i, s in enumerate(sizes) if targets[i] < most * s - 1e-9]
        left = budget - sum(targets)
        if not open_ or left < 1e-9:
            break
        step = min(left / sum(weights[i] for i in open_), min((most * sizes[i] - targets[i]) / weights[i] for i in open_))
        for i in open_:
            targets[i] += step * weights[i]
    return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 10, 10], [5, 500, 1], [7], [300, 20, 900, 40, 1, 60, 80]])
def test_targets_fill_up_by_weight(spark, sizes):
    sized = spark.createDataFrame([(f"svc{k}", s) for k, s in enumerate(sizes)], "service_key string, size bigint")
    found = {r["service_key"]: r["target"] for r in M.service_targets(sized).collect()}
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    for k, wanted in enumerate(filled(sizes, weights, 1.5, 2)):
        assert found[f"svc{k}"] == pytest.approx(wanted, abs=1e-6)


def test_the_mix_comes_near_its_targets(spark):
    draw = random.Random(6)
    rows = [(i, words(i, draw.choice([1, 10, 60])), draw.choice(["b", "a", "c", "c", "c", "c", None, "ö"])) for i in range(900)]
    mix = M.fair_mix(files(spark, *rows).repartition(4))
    found = mix.collect()
    assert len(found) == 900 and {r["times"] for r in found} <= {0, 1, 2}
    by = defaultdict(list)
    for r in found:
        by[r["service_key"]].append(r)
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
    total = sum(r["size"] for r in found)
    assert 1.5 * total - 60 <= sum(r["taken"] for r in found) <= 1.5 * total
    again = M.fair_mix(files(spark, *rows).repartition(7))
    assert got(again, "file_id", "times") == got(mix, "file_id", "times")


def test_mix_of_odd_rows(spark, odd_files, no_files):
    found = M.fair_mix(odd_files)
    assert found.count() == odd_files.count()
    assert found.where("taken > 2 * size or taken < 0").count() == 0
    assert found.where("service_key is null").count() == 2
    assert M.fair_mix(no_files).collect() == []


def test_tag_texts_are_one_tag_per_line(spark):
    tags = [(1, "svc1", 2, "b"), (1, "svc1", 1, "a c"), (1, "svc2", 1, "d"), (2, None, 1, None)]
    df = spark.createDataFrame(tags, "file_id bigint, service_key string, pos bigint, tag string")
    assert got(tag_texts(df), "file_id", "service_key", "tag_text") == [(1, "svc1", "a c\nb"), (1, "svc2", "d"), (2, None, "")]
    assert R.rule_ledger(tag_texts(df)).select(F.sum("n_words")).first()[0] == 4
