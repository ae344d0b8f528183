"""The registered queries of the training-data operators, over their whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, conversations, language, mixing, packing, pages, secrets, simhash, syncmers, token_files, toxicity, vectors, whitening
from quire.llm.common import fold, shared_folder, table

WORD_BPE = "word_bpe_49k.json"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = language.identify(table(spark, sf_dir, "documents"), fold("doc_id", 3) != 1)
    return named.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draws(table(spark, sf_dir, "documents"), count=packing.id_counter(spark, public_tokenizers.path(WORD_BPE)))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in the shared folder, as the result is read from them."""
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"
    return token_files.checksums(token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE)))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_toxicity, op3_document_fingerprints, op4_secret_scans, op5_best_fit_packing, op6_language_id, op7_embedding_near_dedup, op8_token_counts, op9_simhash_near_dedup, op10_source_mixing, op11_conversation_trie, op12_token_files, op13_embedding_whitening)
    return {f.__name__: f for f in found}


#: All pairs of a label, then all that can be reached: for small tables.
LINKED_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS i, vec_id AS c FROM embeddings UNION SELECT r.i, l.w FROM r JOIN l ON r.c = l.u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT i AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(c) AS component_id, i = min(c) AS kept FROM r LEFT JOIN n ON n.u = r.i GROUP BY i
"""


#: Every prefix as a list, for small tables. c32: the lent turns of each conversation, by CRC-32 of its decimal id, bit by bit.
TRIE = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS s FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(s ORDER BY p) AS own FROM t GROUP BY conv_id),
k AS (SELECT conv_id, own, CAST(conv_id AS VARCHAR) AS d FROM o),
c32 AS (SELECT conv_id, own, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(d) + 1), lambda i: [CAST(ascii(d[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h FROM k),
r AS (SELECT c.conv_id AS c, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS s FROM c32 c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 100),
x AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth, s FROM r),
g AS (SELECT depth, s[1:depth] AS p, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = depth) AS ends FROM x GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * length(p[-1].t) ELSE 0 END AS saved FROM g),
e AS (SELECT a.depth, a.p, count(*) FILTER (WHERE d.depth = a.depth + 1) AS n_children, CAST(sum(d.saved) AS BIGINT) AS saved_tokens FROM v a JOIN v d ON d.depth >= a.depth AND d.p[1:a.depth] = a.p GROUP BY 1, 2),
l AS (SELECT a.depth, a.p, count(*) AS n_leaves FROM v a JOIN (SELECT * FROM e WHERE n_children = 0) d ON d.depth >= a.depth AND d.p[1:a.depth] = a.p GROUP BY 1, 2)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, e.n_children, l.n_leaves, e.saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN e ON e.depth = v.depth AND e.p = v.p JOIN l ON l.depth = v.depth AND l.p = v.p LEFT JOIN v u ON u.depth = v.depth - 1 AND v.depth > 0 AND u.p = v.p[1:v.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the other operators are tested against brute force in tests/llm."""
    return {"op7_embedding_near_dedup": LINKED_VECTORS, "op11_conversation_trie": TRIE}
