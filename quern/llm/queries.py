"""The operators of this subpackage over their intended tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import chat_format, decontaminate, exact_dedup, langid, mix, near_dup, ngram_lm, pii, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_read(spark, sf_dir, "documents"), keep="max")


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


_NORMAL = "list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{}', '{}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')".format(
    decontaminate.PUNCTUATION.replace("'", "''"), " " * len(decontaminate.PUNCTUATION)
)

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents), i AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
ds AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k+4], ' ')))) AS s FROM d WHERE len(w) > 0),
isx AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k+4], ' ')))) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM isx GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN isx USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, CAST(shared AS DOUBLE) / item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE 5 * shared >= 4 * item_shingles
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.listed(pii.sanitise(_read(spark, sf_dir, "documents")))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = ngram_lm.train_and_score(docs, ~ngram_lm.is_held_out(F.col("doc_id")))
    return scored.select("doc_id", ngram_lm.is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture; a source weighs the square root of its documents."""
    return mix.interleave(_read(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "warc")
    warc.write(_read(spark, sf_dir, "pages"), path)
    found = warc.resolve(warc.read(spark, path))
    scratch.drop(spark, path)  # all that the result needs has been read into a table
    return found


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d, min(page_id) OVER (PARTITION BY b) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to
FROM q
"""

CONTROL_TEXT = "</s>[INST] ok [/INST]"


#: Characters of a turn on one page of the document that goes with it.
PAGE_CHARS = 2000


def _parts(turn: DataFrame) -> DataFrame:
    """A turn as typed parts: its text in two halves, and after a user's text a document that holds it."""
    part = lambda kind, text, uri, pages: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), uri.cast("string").alias("uri"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), pages.cast("int").alias("pages"))
    none, text = F.lit(None), F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    halves = F.array(part("text", F.left(text, half), none, none), part("text", F.substring(text, half + 1, F.char_length(text)), none, none))
    document = part("document", none, F.concat_ws("/", F.lit("conversations"), F.col("conv_id"), F.col("turn")), F.ceil(F.char_length(text) / PAGE_CHARS))
    return turn.withColumn("parts", F.when(F.col("role") == "user", F.concat(halves, F.array(document))).otherwise(halves))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures are read back from the formatted string, its mask and its attachments, none from the input."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(_parts(turns.unionByName(extra)), parts_col="parts")
    read_back = formatted.withColumn("turns", chat_format.parse_turns(F.col("formatted"))).withColumn("learnt", chat_format.masked_text(F.col("formatted"), F.col("loss_mask")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), chat_format.visible(t["content"]), F.lit("\n"))), "")
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["idx"], a["uri"])), ",").alias("attachments"),
        "expanded_tokens",
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), d AS (
  SELECT *, CASE WHEN role = 'user' THEN count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - 1 END AS idx
  FROM c
), e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|\||/?INST\])', '\1\\\2\3', 'g'))
          + length(regexp_replace(text, '([<\[])(\\*)(/?s>|\||/?INST\])', '\1\\\2\3', 'g')) + 20
          + CASE WHEN idx IS NULL THEN 0 ELSE length('<|document:' || idx || '|>') END AS n
  FROM d
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, count(idx) AS n_attachments,
       coalesce(string_agg(CASE WHEN idx IS NOT NULL THEN concat_ws(':', idx, concat_ws('/', 'conversations', conv_id, turn)) END, ',' ORDER BY idx), '') AS attachments,
       CAST(coalesce(sum(512 * ceil(length(text) / 2000.0)) FILTER (role = 'user'), 0) AS BIGINT) AS expanded_tokens
FROM e GROUP BY conv_id
"""

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_lm_score": op5_lm_score,
    "op6_toxicity": op6_toxicity,
    "op7_minhash_near_dup": op7_minhash_near_dup,
    "op8_mix_sources": op8_mix_sources,
    "op9_warc": op9_warc,
    "op10_chat_format": op10_chat_format,
}

ORACLES = {
    "op1_decontaminate": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op9_warc": OP9_SQL,
    "op10_chat_format": OP10_SQL,
}
