"""Registered queries of the training-data operators, with their SQL.

Each query applies its operator, with production parameters, to its whole
table and derives the contract's columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, extraction, filter_audit, fim, fingerprints, licenses, mixing, neardup, packing, passages, quality, rollups, secrets
from quire.session import scratch_path, stable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    trees = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, trees)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document, with coverage and span."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and a digest of what is kept."""
    out = passages.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed along the curve."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three batches, one of them applied twice: all
    documents counted by words; later copies of a text deleted; what remains
    outside English recounted by the second tokenizer."""
    text, lang = F.col("text"), F.col("lang")
    other = F.coalesce(lang != "en", F.lit(True))
    docs = stable(
        table(spark, sf_dir, "documents").select(
            "doc_id", "source", "lang", F.md5(F.coalesce(text, F.lit(""))).alias("md"),
            rollups.n_tokens(text, "words-1").alias("words"),
            F.when(other, rollups.n_tokens(text, "pieces-2")).alias("pieces"),
        )
    )
    first = docs.groupBy("md").agg(F.min("doc_id").alias("first"))
    docs = stable(docs.join(first, "md").withColumn("copy", F.col("doc_id") > F.col("first")))
    change = lambda d, op, version, tokens, seq: d.select(
        "doc_id", F.lit(op).alias("op"), F.lit(seq).alias("seq"), "source", "lang", F.lit(version).alias("version"), F.col(tokens).alias("tokens")
    )
    roll = rollups.Rollup(spark, scratch_path(spark, "token-counts"))
    roll.apply("1-insert", change(docs, "upsert", "words-1", "words", 1))
    copies = change(docs.where("copy"), "delete", "words-1", "words", 2)
    roll.apply("2-copies", copies)
    roll.apply("2-copies", copies)  # a replay, which changes nothing
    roll.apply("3-recount", change(docs.where("NOT copy").where(other), "upsert", "pieces-2", "pieces", 3))
    return roll.totals()


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "keep")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    _, per_doc = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return per_doc.select("doc_id", "size", "source_size", "target", "taken")


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, read back from its formatted examples."""
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.expand_examples(turns))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-middle example, and rebuilt from it."""
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders, per language."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_license_scan": op3_license_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_syncmers": op9_syncmers,
    "op10_chat_format": op10_chat_format,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_html_extraction": op12_html_extraction,
    "op13_filter_audit": op13_filter_audit,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op4_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), spots AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM words
), windows AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS least_id FROM spots
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM windows WHERE least_id < doc_id
), removed AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed,
         CASE WHEN js IS NULL THEN w
              ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(js, x)), lambda x: w[x]) END AS k
  FROM words LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
""",
    "op6_token_counts": r"""
WITH d AS (SELECT *, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents)
SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-1' ELSE 'pieces-2' END AS version,
       CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(CASE WHEN lang = 'en' THEN len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))
                ELSE len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')) END) AS BIGINT) AS n_tokens
FROM d WHERE doc_id = first_id GROUP BY 1, 2, 3
""",
    "op10_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(text, '(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|TURN\]|/TURN\])', '\1\\\2\3', 'g') AS esc,
         CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 15 END AS marks
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(esc) + marks) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (role = 'assistant') + CASE WHEN max_by(role, turn) <> 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS n_examples
FROM e GROUP BY conv_id
""",
    "op11_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), x AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS i, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS j,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), y AS (
  SELECT *, array_to_string(u[:least(i, j)], '') AS p, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS m,
         array_to_string(u[greatest(i, j) + 1:], '') AS s
  FROM x
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM y
""",
    "op13_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), m AS (
  SELECT part, (len(w) < 100)::INT AS a, (100 * len(list_distinct(w)) < 80 * len(w))::INT AS b,
         (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(doc_id > first_id, false)::INT AS e,
         coalesce(l.quality = 1, false)::INT AS good, coalesce(l.toxic = 1, false)::INT AS toxic
  FROM w LEFT JOIN labels l USING (doc_id)
), x AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a + b + c + d + e AS n_fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM m GROUP BY 1, 2, 3
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM f p, f q, f r, f s, f t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, left(filter_order, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), y AS (
  SELECT part, filter_order, step, s.f, n, good, toxic, n_fails, x.fails[s.f] = 1 AS fail,
         list_sum(list_transform(string_split(before, ''), lambda z: coalesce(x.fails[z], 0))) > 0 AS gone
  FROM x, steps s
), z AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fail AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT * REPLACE (coalesce(gone, false) AS gone) FROM y) GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM z
""",
}
