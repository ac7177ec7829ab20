"""Quality rules for tag texts as a ledger of bits.

Every rule is evaluated once per file. The ledger keeps what was measured and one bit per failed
rule; which rules count is a policy, a mask with a version, that is applied afterwards. Trying
another policy, or asking what one rule alone rejects, reads the ledger and not the texts.
Column expressions only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.llm.texts import GAP, WORD, whole_text

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"

# Rule name -> condition of failure over the measured columns; the bit is the place in this list.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
}
BASE = ("few_words", "repeated_words")
# Policy version -> the rules that reject under it.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask_of(rules: tuple[str, ...]) -> int:
    """The bits of some rules as one number."""
    places = {name: bit for bit, name in enumerate(RULES)}
    return sum(1 << places[name] for name in rules)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words inside some window of five words that stands in the text twice or more."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - WINDOW)

    def digest(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])

    def covered(at: Column) -> Column:
        steps = F.transform(
            F.sequence(F.lit(1), F.size(at) - 1),
            lambda k: F.least(F.lit(WINDOW), F.get(at, k) - F.get(at, k - 1)),
        )
        total = F.aggregate(steps, F.lit(0), lambda a, b: a + b) + WINDOW
        return F.when(F.size(at) == 0, F.lit(0)).when(F.size(at) == 1, F.lit(WINDOW)).otherwise(total)

    def marked(rows: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce(F.get(rows, a)["w"] == F.get(rows, b)["w"], F.lit(False))

        twice = F.filter(
            F.sequence(F.lit(0), F.size(rows) - 1), lambda k: same(k, k - 1) | same(k, k + 1)
        )
        return F.sort_array(F.transform(twice, lambda k: F.get(rows, k)["at"]))

    # Windows with different digests differ for certain; equal digests are settled by the words.
    distinct = _let(F.transform(starts, digest), lambda d: F.size(F.array_distinct(d)) == F.size(d))
    # Not a slice: that copies the whole array each time.
    windows = F.transform(
        starts,
        lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("w"), i.alias("at")),
    )
    exact = _let(_let(F.sort_array(windows), marked), covered)
    return F.when(n <= WINDOW, F.lit(0)).when(distinct, F.lit(0)).otherwise(exact)


def rule_ledger(files: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of `files`: file_id, what was measured of its whole `tag_text`, `fail_bits`.

    Columns named in `carry` are handed through; they must not bear the names of those above.

    Words are runs of characters other than ASCII white space, lines are what line feeds separate.
    `word_chars` are the code points in words; `n_lines` the lines with a word and `n_dup_lines`
    those of them that equal an earlier line; `n_repeat_words` the words inside a window of five
    words that occurs at least twice, the first occurrence included.

    A null text is an empty one: it measures zero everywhere and fails `few_words`. A null
    `file_id` is kept, repeated rows are measured separately, further columns are ignored, and an
    empty table gives an empty ledger. No row depends on another, so nothing is shuffled.
    """
    text = F.col("_text")
    has_word = r"[^\x20\x09-\x0D]"
    split = files.select("file_id", whole_text().alias("_text"), *carry).select(
        "file_id",
        *carry,
        F.length(F.regexp_replace(text, GAP, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.filter(F.split(text, GAP + "+"), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(has_word)).alias("_lines"),
    )
    # A condition on the ledger must not be moved below the measuring, where it would measure again;
    # it stays above a column that is not deterministic.
    n_words = F.when(F.monotonically_increasing_id() >= 0, F.size("_words")).otherwise(F.lit(0))
    measured = split.select(
        "file_id",
        *carry,
        n_words.cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _let(F.col("_words"), _repeated_words).cast("bigint").alias("n_repeat_words"),
    )
    bits = [
        F.when(F.expr(failed), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, failed in enumerate(RULES.values())
    ]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.select("file_id", *carry, *MEASURES, total.cast("bigint").alias("fail_bits"))


def apply_policy(ledger: DataFrame, version: str, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """The ledger with `policy`, `base_failed` and `kept`; the base rules always reject.

    Null `fail_bits` come from no ledger of ours; such a row is not kept.
    """
    failed = F.coalesce(F.col("fail_bits"), F.lit(-1))
    base = failed.bitwiseAND(F.lit(mask_of(BASE))) != 0
    own = failed.bitwiseAND(F.lit(mask_of(policies[version]))) != 0
    return ledger.withColumns({"policy": F.lit(version), "base_failed": base, "kept": ~(base | own)})


def ablations(ledger: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per policy and rule: files that fail the rule, that the policy rejects, and that only this rule rejects.

    The ledger is folded to one row per combination of bits first, so everything after that is as
    small as the number of rules allows.
    """
    combined = ledger.groupBy("fail_bits").agg(F.count("*").alias("files"))
    cells = [
        F.struct(F.lit(v).alias("policy"), F.lit(rule).alias("rule"), F.lit(mask_of((rule,))).alias("bit"), F.lit(mask_of(rules)).alias("mask"))
        for v, rules in policies.items()
        for rule in rules
    ]
    rejected = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def files(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("files"))), F.lit(0)).alias(name)

    return (
        combined.select("fail_bits", "files", F.inline(F.array(*cells)))
        .groupBy("policy", "rule")
        .agg(
            files(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, "failing"),
            files(rejected != 0, "rejected"),
            files(rejected == F.col("bit"), "only_this_rule"),
        )
    )
