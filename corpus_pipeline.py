"""The corpus pipeline: documents in, packed training sequences out, in five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import checkpoint, removed, shared_folder, whole
from quire.llm.language import labeller, learn
from quire.llm.mixing import Mix, draws
from quire.llm.packing import id_counter, pack_documents
from quire.llm.secrets import redact
from quire.llm.simhash import simhash_groups

VOCABULARY = "word_bpe_49k.json"
MIX = Mix(entropy=0.9, repeats=4.0, cover=True)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and those without a letter. Learns from the labelled documents themselves; any text with letters stays."""
    named = labeller(docs, learn(docs))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), named(whole("text"))["lang_pred"].alias("lang_pred"))
    return rows.filter("lang_pred <> 'und'").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: that with the smallest id, and of texts that share that id the first by a hash; without an id only where none of the group has one. Texts that share an id but are unlike each other all stay; of rows equal in id and text one does."""
    hashes = [F.xxhash64(F.lit(i), "doc_id", "text") for i in (0, 1)]
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), *[h.alias(f"h{i}") for i, h in enumerate(hashes)])
    groups = simhash_groups(docs.select(key.alias("key"), "text"), id_col="key")
    stay = groups.filter("key = component_id").groupBy("key").agg(F.count("*").alias("rows"))
    stay = checkpoint(stay.select(F.col("key.h0").alias("h0"), F.col("key.h1").alias("h1"), "rows"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[h.alias(f"h{i}") for i, h in enumerate(hashes)])
    once = rows.join(stay.filter("rows = 1"), ["h0", "h1"], "left_semi")
    repeated = rows.join(stay.filter("rows > 1"), ["h0", "h1"], "left_semi").dropDuplicates(["h0", "h1"])  # reduced before it is shuffled
    return once.unionByName(repeated).select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked and n_chars follows; no document goes."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until their sources weigh, in tokens, what the mix asks for; every one is drawn at least once. Null sources are one source, null texts have no tokens; ties between equal places are broken by id."""
    count = id_counter(spark, public_tokenizers.path(VOCABULARY))
    names = [f"c{i}" for i in range(len(docs.columns))]
    return draws(docs, MIX, count, keep=True).toDF(*names, "at").select(*names).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; null texts are the end token alone, ties between equal lengths are broken by task and order."""
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("simhash_near_dedup", near_dedup), ("secret_scans", secret_scan), ("source_mixing", mix_sources), ("best_fit_packing", pack),
]

#: SQL can express neither the learned languages nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder as Parquet and read again. A stage's table goes once the next one's is written; the last stays, as the result is read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
