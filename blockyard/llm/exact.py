"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Only compact keys are shuffled.  One scan counts (length, prefix hash) keys;
lengths that occur once are dropped first, then keys that do.  The second scan
hashes the full text of the rows whose key survived.  All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, materialize, scratched, sized

PREFIX = 128


def normalised(text: Column) -> Column:
    """Text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    norm = normalised(F.col(text))
    return docs.select(
        F.length(norm).alias("_len"),
        F.xxhash64(F.length(norm), F.substring(norm, 1, PREFIX)).alias("_key"),
        "*",
    )


def surviving_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """Keys (hash of length and prefix) that at least two rows share."""
    keys = _keyed(docs.select(text), text).groupBy("_len", "_key").count()
    keys = materialize(keys, "exact-keys")
    # Lengths first: one that a single row has needs no prefix.
    lengths = keys.groupBy("_len").agg(F.sum("count").alias("n")).where("n > 1").select("_len")
    alive = keys.join(lengths, "_len", "left_semi").where(F.col("count") > 1)
    return materialize(alive.select("_key"), "exact-alive")


@scratched
def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, sha256.

    Of rows whose normalised texts are equal the one with the smallest id stays;
    a null id comes last, and of rows repeated whole exactly one is kept.
    ``sha256`` is null for rows that no other can equal, unless ``hash_all``.
    An empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    base = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    alive = sized(surviving_keys(base, "_text")).withColumn("_alive", F.lit(True))
    digest = F.sha2(normalised(F.col("_text")).cast("binary"), 256)
    rows = _keyed(base, "_text").join(alive, "_key", "left").select(
        "_id",
        F.col("_alive").isNotNull().alias("_alive"),
        (digest if hash_all else F.when(F.col("_alive"), digest)).alias("_sha"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialize(rows, "exact-rows")
    groups = (
        rows.where("_alive")
        .groupBy("_sha")
        .agg(F.count("*").alias("_n"), F.min(F.struct(F.isnull("_id").alias("no"), "_id", "_row")).alias("_keep"))
        .where("_n > 1")
    )
    groups = sized(materialize(groups, "exact-groups"))
    return rows.join(groups, "_sha", "left").select(
        F.col("_id").alias(id),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_n").isNull() | (F.col("_keep._row") == F.col("_row"))).alias("kept"),
        F.col("_sha").alias("sha256"),
    )


@scratched
def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without copies: of equal normalised texts the smallest id stays.

    Columns stay as they are.  Rows repeated whole leave one row; a null id
    counts as the largest.
    """
    columns = docs.columns
    sha, gone_id, gone_sha = fresh(columns, "_sha", "_gone", "_gone_sha")
    gone = exact_groups(docs, id, text).where("group_size > 1")
    gone = materialize(gone.select(F.col(id).alias(gone_id), F.col("sha256").alias(gone_sha), "kept"), "exact-gone")
    # ids all of whose rows go (by text); an id kept once for a text stays once
    pairs = gone.groupBy(gone_id, gone_sha).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n"))
    pairs = materialize(pairs.where("not _kept or _n > 1"), "exact-pairs")
    if pairs.isEmpty():
        return docs
    dropped = pairs.where("not _kept").select(gone_id, gone_sha)
    repeated = pairs.where("_kept").select(gone_id, gone_sha)
    keyed = docs.withColumn(sha, F.sha2(normalised(F.col(text)).cast("binary"), 256))
    match = F.col(id).eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha))
    left = keyed.join(sized(dropped), match, "left_anti")
    if not repeated.isEmpty():
        twice = left.join(sized(repeated), match, "left_semi").dropDuplicates([id, sha])
        left = left.join(sized(repeated), match, "left_anti").unionByName(twice)
    return left.select(*[F.col(f"`{c}`") for c in columns])
