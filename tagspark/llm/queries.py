"""The operators applied to the given tables, and their checking SQL.

A document is a file of the library: its id is `file_id`, its text `tag_text`, its source
`service_key`. Queries map the tables to an operator's records and its results back.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagspark.llm import (
    block_names,
    fair_mix,
    packing,
    page_text,
    passages,
    preferences,
    prefix_trie,
    quality_votes,
    repeated_runs,
    rule_ledger,
    simhash,
    source_divergence,
    token_files,
)
from tagspark.operators.ordered import with_ordinal
from tagspark.session import cut_lineage, fresh_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with its checking SQL if SQL can express it."""

    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def as_files(documents: DataFrame, *more: str) -> DataFrame:
    """Documents as files of the library."""
    return documents.select(
        F.col("doc_id").alias("file_id"), F.col("text").alias("tag_text"), F.col("source").alias("service_key"), *more
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    return as_files(table(spark, folder, "documents"))


def as_documents(found: DataFrame) -> DataFrame:
    return found.withColumnRenamed("file_id", "doc_id")


@query()
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    marks = table(spark, folder, "labels").select(F.col("doc_id").alias("file_id"), F.col("quality").alias("archived"))
    return as_documents(quality_votes.quality_votes(files(spark, folder), marks))


@query(
    r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS same FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY same ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY same) AS group_size FROM plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM ranked
"""
)
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = block_names.duplicate_files(files(spark, folder))
    return as_documents(found.select("file_id", "keep_id", "group_size", "kept", "text_sha256"))


@query(
    r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
parts AS (
  SELECT doc_id, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 4)) AS place, unnest(list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i+4], ' '))) AS w
  FROM parts WHERE len(words) >= 5),
twice AS (SELECT doc_id, place FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(generate_series(place, place + 4)) AS place FROM twice) GROUP BY doc_id),
measured AS (
  SELECT p.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id),
failed AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END) AS BIGINT) AS fail_bits FROM measured)
SELECT *, 'v1' AS policy, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM failed
"""
)
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return as_documents(rule_ledger.apply_policy(rule_ledger.rule_ledger(files(spark, folder)), "v1"))


@query(
    r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || CAST(doc_id AS VARCHAR)) AS shuffled FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM sources),
budget AS (SELECT sum(source_size) * CAST(1.5 AS DOUBLE) AS words FROM sources),
full_ AS (
  SELECT a.source, sum(least(CAST(b.most AS DOUBLE), b.weight * (a.most / a.weight))) <= (SELECT words FROM budget) AS is_full
  FROM weighed a, weighed b GROUP BY a.source),
level AS (
  SELECT ((SELECT words FROM budget) - coalesce(sum(w.most) FILTER (WHERE is_full), 0)) / sum(w.weight) FILTER (WHERE NOT is_full) AS v
  FROM weighed w JOIN full_ f ON w.source IS NOT DISTINCT FROM f.source),
targets AS (
  SELECT w.*, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), (SELECT v FROM level) * weight) END AS target
  FROM weighed w JOIN full_ f ON w.source IS NOT DISTINCT FROM f.source),
served AS (
  SELECT s.*, t.source_size, t.place, t.weight, t.target, sum(s.size) OVER (PARTITION BY t.place ORDER BY shuffled, doc_id) AS served
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, sum(size) OVER (ORDER BY (again * source_size + served) / weight, place, again, shuffled, doc_id ROWS UNBOUNDED PRECEDING) AS total
  FROM served, (SELECT 0 AS again UNION ALL SELECT 1)),
taken AS (SELECT doc_id, count(*) AS times FROM copies WHERE total <= (SELECT words FROM budget) GROUP BY doc_id)
SELECT s.doc_id, s.source AS service_key, s.size, s.source_size, s.target, CAST(coalesce(t.times, 0) AS INTEGER) AS times,
  CAST(coalesce(t.times, 0) * s.size AS BIGINT) AS taken
FROM served s LEFT JOIN taken t ON s.doc_id = t.doc_id
"""
)
def op4_mix_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    return as_documents(fair_mix.fair_mix(files(spark, folder)))


def preference_sessions(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions in pairs that share turns, and the pairs.

    Of each conversation with an answer, its turns up to the last answer are chosen; rejected is the
    same with the last answer of the next conversation (else of the one before, else an empty one).
    """
    known = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    answers = known.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("a"))
    answers = cut_lineage(answers.select("conv_id", F.col("a.turn").alias("last"), F.col("a.text").alias("answer")), "answers")
    near = answers.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer").alias("next"))
    before = answers.select((F.col("conv_id") + 1).alias("conv_id"), F.col("answer").alias("before"))
    given = answers.join(near, "conv_id", "left").join(before, "conv_id", "left")
    other = given.select("conv_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("next", "before", F.lit("")).alias("text"))
    turns = known.join(answers.select("conv_id", "last"), "conv_id").where("turn <= last")
    columns = ["conv_id", "turn", "role", "text"]
    sides = turns.select((F.col("conv_id") * 2).alias("session_id"), *columns[1:]).unionByName(
        turns.where("turn < last").select(*columns).unionByName(other).select((F.col("conv_id") * 2 + 1).alias("session_id"), *columns[1:])
    )
    pair = F.col("conv_id").alias("pair_id")
    pairs = answers.select(pair, (F.col("conv_id") * 2).alias("chosen_session"), (F.col("conv_id") * 2 + 1).alias("rejected_session"))
    return sides.withColumnRenamed("turn", "seq"), pairs


@query(
    r"""
WITH known AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
answers AS (
  SELECT conv_id, turn AS last, text AS answer FROM known WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) = 1),
shared AS (SELECT k.*, last FROM known k JOIN answers a ON a.conv_id = k.conv_id WHERE turn <= last),
turns AS (
  SELECT DISTINCT conv_id AS pair_id, TRUE AS chosen, turn AS seq, role, text FROM shared
  UNION SELECT conv_id, FALSE, turn, role, text FROM shared WHERE turn < last
  UNION SELECT a.conv_id, FALSE, a.last, 'assistant', coalesce(n.answer, b.answer, '')
  FROM answers a LEFT JOIN answers n ON n.conv_id = a.conv_id + 1 LEFT JOIN answers b ON b.conv_id = a.conv_id - 1),
sides AS (
  SELECT pair_id, seq, list(role || chr(0) || text ORDER BY role, text) FILTER (WHERE chosen) AS c,
    list(role || chr(0) || text ORDER BY role, text) FILTER (WHERE NOT chosen) AS r FROM turns GROUP BY pair_id, seq),
apart AS (SELECT pair_id, min(seq) AS apart FROM sides WHERE c IS DISTINCT FROM r GROUP BY pair_id),
parts AS (
  SELECT t.*, CASE WHEN apart IS NULL OR seq < apart THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS part
  FROM turns t LEFT JOIN apart a ON t.pair_id = a.pair_id),
written AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, length(role) + 5 AS head
  FROM parts WHERE part <> 'prompt' OR chosen),
along AS (
  SELECT *, CAST(length(rendered) AS BIGINT) AS n_chars,
    CAST(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY seq, role, text) AS BIGINT) AS upto FROM written)
SELECT pair_id, part, seq, role, rendered, upto - n_chars AS start, n_chars,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN upto - n_chars + head END AS loss_start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN upto END AS loss_end
FROM along
"""
)
def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return preferences.preference_segments(*preference_sessions(table(spark, folder, "conversations")))


@query()
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.page_texts(table(spark, folder, "pages"))


@query()
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return as_documents(passages.shared_passages(files(spark, folder))).withColumnRenamed("other_file", "other_doc")


@query()
def op8_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_files(files(spark, folder), VOCABULARY, with_ids=False)
    return as_documents(packed.drop("ids"))


@query()
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(files(spark, folder), path, VOCABULARY)
    return as_documents(token_files.read_token_files(spark, path).drop("ids"))


@query()
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return as_documents(simhash.near_duplicates(files(spark, folder)))


@query(
    """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT *, unnest(generate_series(0, n - 50)) AS i FROM texts WHERE n >= 50)),
firsts AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w),
late AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE doc_id > first_doc),
opens AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS o FROM late),
grouped AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM opens),
runs AS (SELECT doc_id, min(i) AS low, max(i) + 50 AS high FROM grouped GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS low, low AS high FROM runs
  UNION ALL SELECT doc_id, max(high), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * low + 1, 2 * (coalesce(high, n) - low)), '' ORDER BY low) AS k FROM gaps g JOIN texts t ON g.doc_id = t.doc_id GROUP BY g.doc_id),
counted AS (SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts t LEFT JOIN counted c ON t.doc_id = c.doc_id LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
)
def op11_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_runs.repeated_runs(files(spark, folder))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["length"])
    spans = F.size("spans").cast("bigint")
    return as_documents(found).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def rebuilt_sessions(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of conversations that begin with h turns of another one, and all their ids."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    )
    ranked = cut_lineage(with_ordinal(turns, "turn", "rank", ["conv_id"]), "ranked-turns")
    ids = ranked.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    own = ranked.where(F.col("rank") >= h).select("conv_id", "rank", "role", "text")
    heads = ranked.where("rank < 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "rank", "role", "text")
    taken = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base")).join(heads, "base")
    events = own.unionByName(taken.where(F.col("rank") < h).select("conv_id", "rank", "role", "text"))
    as_events = events.select(F.col("conv_id").alias("session_id"), F.col("rank").alias("seq"), F.col("role").alias("type"), "text")
    return as_events, ids.select(F.col("conv_id").alias("session_id"))


@query(
    r"""
WITH ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS r
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT conv_id, xor(CAST(4294967295 AS BIGINT), list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1))))) % 4 AS h
  FROM ranked),
rebuilt AS (
  SELECT i.conv_id, r, role, text FROM ids i JOIN ranked o ON o.conv_id = i.conv_id WHERE r >= h
  UNION ALL SELECT i.conv_id, r, role, text FROM ids i JOIN ranked o ON o.conv_id = i.conv_id - i.conv_id % 20 WHERE r < h),
sequences AS (
  SELECT i.conv_id, coalesce(list(role || chr(1) || text ORDER BY r) FILTER (WHERE r IS NOT NULL), []) AS s,
    coalesce(list(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) ORDER BY r) FILTER (WHERE r IS NOT NULL), []) AS w
  FROM ids i LEFT JOIN rebuilt b ON b.conv_id = i.conv_id GROUP BY i.conv_id),
members AS (SELECT *, unnest(generate_series(0, len(s))) AS d FROM sequences),
nodes AS (
  SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(w[d]), 0) AS words,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '') AS ends
  FROM members GROUP BY s[1:d], d),
children AS (SELECT p[1:d-1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY p[1:d-1], d - 1),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.p = n.p),
sums AS (
  SELECT a.p, a.d, CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n - 1) * b.words) AS BIGINT) AS saved_tokens
  FROM counted a JOIN counted b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.p, a.d)
SELECT c.conv_id, c.d AS depth, up.conv_id AS parent_conv_id, c.n AS n_convs, c.n_children, n_leaves, saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN sums s ON s.d = c.d AND s.p = c.p LEFT JOIN counted up ON up.d = c.d - 1 AND up.p = c.p[1:c.d-1]
"""
)
def op12_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = prefix_trie.prefix_trie(*rebuilt_sessions(table(spark, folder, "conversations")))
    return found.drop("n_ends").withColumnsRenamed(
        {"session_id": "conv_id", "parent_session_id": "parent_conv_id", "n_sessions": "n_convs", "saved_words": "saved_tokens"}
    )


@query(
    r"""
WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
found AS (SELECT r, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grouped AS (
  SELECT g.lang, g.source, coalesce(s.v, 0) AS v, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM texts) g LEFT JOIN sizes s ON s.lang = g.lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // CAST(g.total + g.v AS HUGEINT) AS p
  FROM grouped g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
langs AS (
  SELECT k.lang, k.term, 1 + 1000000000 * (sum(n) + 1) // CAST(any_value(t.total) + any_value(s.v) AS HUGEINT) AS q
  FROM kept k JOIN counts c ON c.lang = k.lang AND c.term = k.term JOIN sizes s ON s.lang = k.lang
  JOIN (SELECT lang, sum(n) AS total FROM counts GROUP BY lang) t ON t.lang = k.lang GROUP BY k.lang, k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
bare AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, (p - q) * (p - q) // q AS value FROM shares s JOIN langs l ON l.lang = s.lang AND l.term = s.term WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM bare UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
)
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("lang").alias("mime"), F.col("source").alias("service_key"), F.col("text").alias("tag_text")
    )
    found = source_divergence.source_divergence(texts)
    return found.withColumnsRenamed({"mime": "lang", "service_key": "source"})
