"""The corpus pipeline: five stages over ``documents``, each an operator of the library.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner
writes it as Parquet in the shared folder and reads it back as the next stage's
input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockyard.llm import bpe, decontaminate, exact, near, quality
from blockyard.llm.common import crc_mod, drop_table, fresh, materialize, read, scratched, sized, text_digest

#: A document goes if its score is below this.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Rows that share an id, or have none, are judged one by one; null and empty
    texts have a score too.  An empty table stays empty.
    """
    bad_id, bad_text = fresh(docs.columns, "_bad", "_digest")
    keyed = docs.select("doc_id", "text", text_digest(F.col("text")).alias("digest"))
    scored = quality.score(keyed, read(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0, keep=("digest",))
    bad = scored.where(F.col("score") < LEAST_QUALITY).select(F.col("doc_id").alias(bad_id), F.col("digest").alias(bad_text)).distinct()
    match = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (text_digest(F.col("text")) == F.col(bad_text))
    return docs.join(sized(materialize(bad, "rejected")), match, "left_anti")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal normalised texts, that of the smallest id; null counts as empty."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; texts without words stay."""
    return near.drop_near_copies(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; texts without words hold none."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the bytes they decode to; a null text has none."""
    import public_tokenizers

    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: The classifier and the tokenizer are not SQL; tests/test_pipeline.py compares stages and run with brute force that takes the classifier's scores as given.
ORACLE_SQL = None


@scratched
def _run(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for ``documents`` of ``sf_dir``."""
    return _run(read(spark, sf_dir, "documents"), spark, sf_dir)
