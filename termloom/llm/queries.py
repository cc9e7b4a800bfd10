"""The registered queries of the subpackage: thin digests over the operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import arc_warc, chat_format, class_lm, decontaminate, embedding_dedup, jaccard_join, language_id, line_dedup, packing, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item with at most a tenth of its characters edited."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.1)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as ARC, converted to WARC with revisits, and read back."""
    done = arc_warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
  FROM pages),
g AS (
  SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::BIGINT) AS words FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(words, lambda w:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((w >> 15) & 31), 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((w >> 10) & 31), 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((w >> 5) & 31), 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (w & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM g
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more in 3 or more documents stay in the largest doc_id only."""
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 AND doc_id IS NOT NULL
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(s.keeper <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.93 or more."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


OP4_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT m.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, least(m.vec_id, coalesce(c.low, m.vec_id)) AS component_id,
       least(m.vec_id, coalesce(c.low, m.vec_id)) = m.vec_id AS kept
FROM embeddings m
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) k ON k.a = m.vec_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = m.vec_id
"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the unigram reading of the 32k vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the three folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(~language_id.held_out()))
    judged = language_id.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", language_id.held_out().alias("held_out"), F.col("tl_lang").alias("lang_pred"), F.col("tl_score").alias("score"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, replace(coalesce(text, ''), '<|', '< |') AS said,
         coalesce(nullif(regexp_replace(role, '[ \t\n\x0B\f\r<|>]+', '_', 'g'), ''), 'unknown') AS who
  FROM conversations WHERE conv_id IS NOT NULL),
spans AS (SELECT *, floor(turn / 256) AS span, (row_number() OVER (PARTITION BY conv_id, floor(turn / 256) ORDER BY turn, who, said) - 1) // 256 AS part FROM turns),
ranked AS (SELECT *, (dense_rank() OVER (PARTITION BY conv_id ORDER BY span NULLS FIRST, part) - 1)::BIGINT AS block FROM spans),
placed AS (SELECT *, 1 + max(block) OVER (PARTITION BY conv_id) AS n_blocks FROM ranked),
people AS (SELECT DISTINCT conv_id, who AS perspective FROM turns WHERE who <> 'system'),
parts AS (
  SELECT t.conv_id, p.perspective, t.block, t.n_blocks, t.turn, t.who, t.said, t.who = p.perspective AS own,
         '<|im_start|>' || CASE WHEN t.who = p.perspective THEN 'assistant' WHEN t.who = 'system' THEN 'system'
                                ELSE 'user name=' || t.who END || chr(10) AS head,
         t.said || '<|im_end|>' AS body
  FROM placed t JOIN people p USING (conv_id))
SELECT conv_id, perspective, block, n_blocks, count(*)::BIGINT AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, who, said) AS rendered,
       string_agg(CASE WHEN own THEN 'u' || length(head) || ' m' || length(body) || ' u1'
                       ELSE 'u' || (length(head) + length(body) + 1) END, ' ' ORDER BY turn NULLS FIRST, who, said) AS mask_runs,
       coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_masked
FROM parts GROUP BY conv_id, perspective, block, n_blocks
"""


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based log10 probability of every document, with the add-one unigram base."""
    return class_lm.score_documents(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_arc_to_warc": op2_arc_to_warc,
    "op3_line_dedup": op3_line_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_class_lm": op9_class_lm,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_arc_to_warc": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op8_chat_formatting": OP8_SQL,
}
