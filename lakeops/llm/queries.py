"""The registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm import (
    edit_counts,
    exact_dedup,
    masked_lm,
    mixing,
    near_dedup,
    personal_data,
    reply_trees,
    sampled_pieces,
    simhash,
    source_audit,
    token_files,
    toxicity,
    whitening,
)
from lakeops.llm.common import stored
from lakeops.session import new_work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *[personal_data.count_of(base, kind).alias(f"n_{kind}") for kind in personal_data.KINDS],
        F.sha2(personal_data.spans_text(base), 256).alias("base_sha256"),
        personal_data.spans_text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.mixed_copies(table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return copies.select("doc_id", "size", "source_size", "target", taken)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(~toxicity.eligible(F.col("doc_id")), F.lit(False))
    return toxicity.scored_documents(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_work_dir(spark, "token-files")
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    read = token_files.read_token_files(spark, folder, files)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = masked_lm.pseudo_likelihoods(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_tokens",
        F.round("log_likelihood", 2).alias("log_likelihood"),
        F.round("mean_log_likelihood", 4).alias("mean_log_likelihood"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = simhash.compared_with_next(table(spark, sf_dir, "documents"))
    found = stored(compared.withColumn("row", F.monotonically_increasing_id()), "simhash")
    queries = found.filter("doc_id % 50 = 0").select(F.col("row").alias("query"), "fingerprint")
    near = simhash.within_radius(found.select("fingerprint"), queries)
    counts = near.groupBy("query").agg((F.sum("copies") - 1).alias("n_near"))
    hex_of = lambda name: F.lower(F.hex(name)).alias(name)
    return found.join(counts, found["row"] == counts["query"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_of("fingerprint"),
        hex_of("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_near",
    )


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits a document, placed by a hash of doc_id: one replaces, one deletes.

    The trees are kept as a table beside the texts; the edits come to them afterwards.
    """
    trees = stored(edit_counts.with_trees(table(spark, sf_dir, "documents")), "edit-trees")
    place = F.pmod(F.xxhash64("doc_id"), F.length("text").cast("long") + 1)
    edits = F.array(
        F.struct(
            F.floor(place / 2).alias("start"),
            (F.floor(place / 2) + 30).alias("end"),
            F.concat(F.lit(" edited, "), F.substring("text", 1, 24)).alias("text"),
        ),
        F.struct(
            (place + 40).alias("start"), (place + 60).alias("end"), F.lit("").alias("text")
        ),
    )
    return edit_counts.recounted(trees.withColumn("edits", edits)).select(
        "doc_id",
        "n_tokens",
        "edited_tokens",
        "leaves",
        "encoded_chars",
        F.length("text").cast("long").alias("edited_chars"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampled_pieces.sampled_segmentations(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "sample",
        "n_pieces",
        F.round("log_p", 6).alias("log_p"),
        F.round("log_inclusion", 6).alias("log_inclusion"),
        F.crc32("ids").alias("ids_crc32"),
        "decodes",
    )


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(
        table(spark, sf_dir, "documents"), width=3, percent=85
    )
    return found.select(
        "doc_id",
        "n_shingles",
        "component_id",
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, a tree without branches, and one that holds control strings."""
    controls = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    replies, texts = reply_trees.chained(rows.unionByName(controls))
    folder = new_work_dir(spark, "conversations")
    written = reply_trees.write_conversations(reply_trees.reply_paths(replies), texts, folder)
    return reply_trees.digests(written).drop("path").withColumnRenamed("tree", "conv_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whitened(table(spark, sf_dir, "embeddings")))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergences(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_masked_lm": op5_masked_lm,
    "op6_simhash": op6_simhash,
    "op7_edit_counts": op7_edit_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sampled_pieces": op9_sampled_pieces,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_reply_trees": op11_reply_trees,
    "op12_whitening": op12_whitening,
    "op13_source_audit": op13_source_audit,
}

ORACLES = {
    "op8_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM n
WINDOW g AS (PARTITION BY t ORDER BY chars DESC, doc_id)
""",
    "op11_reply_trees": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
written AS (
  SELECT *, regexp_replace(text, '(\\*(?:###|</turn>))', '\\\1', 'g') AS body,
         replace(replace(role, '%', '%25'), chr(10), '%0A') AS head
  FROM rows)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text))
         AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 15) AS BIGINT) AS formatted_chars
FROM written
GROUP BY conv_id
""",
    "op13_source_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (
  SELECT row, lang, source,
         unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (
  SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
each AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, c,
         1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p
  FROM each JOIN v USING (lang)),
whole AS (
  SELECT lang, term,
         1 + (1000000000::HUGEINT * (sum(c) + 5)) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
  FROM each JOIN v USING (lang) GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b USING (lang, term) GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT)
  FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found
QUALIFY part = 'pair' OR rank <= 50
""",
}
