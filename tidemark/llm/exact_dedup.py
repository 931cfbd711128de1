"""Operator 3, exact dedup: a tree merge of sorted digest runs.

Every input partition is one run of (digest, keeper, size). In each round the
runs whose numbers agree after dropping four bits meet: a shuffle on
(run, digest) brings equal digests of up to 16 runs together and the sorted
merge keeps one row for each, so copies are combined at every level before they
travel on. No level gathers a group: a digest that a third of all rows hold is
at most 16 rows per merge. A digest is SHA-256 plus byte length plus an
independent 64-bit hash; rows count as equal only when all three agree, which
is what "verified" means here, at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, by_ids, free_name, read_table, stored

FAN_IN_BITS = 4
DIGEST = ["text_sha256", "text_bytes", "text_xx"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts are equal when identical after lower-casing
    A-Z. keep is "max" or "min": which id of equal texts stays. A null id stays
    only when its whole group has none. Rows repeated with one id form one group
    and exactly one of them is kept. Other columns of docs are ignored, so
    clashing names do no harm. Empty input gives no rows.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    digests = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.sha2("t", 256).alias("text_sha256"),
        F.octet_length("t").cast("long").alias("text_bytes"),
        F.xxhash64("t").alias("text_xx"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    digests = stored(digests, "digests")
    best = (F.max if keep == "max" else F.min)
    # A null id loses to any other; ties go to the earliest row.
    rank = F.struct(F.col("doc_id").isNotNull().alias("has") if keep == "max" else F.col("doc_id").isNull().alias("has"), F.col("doc_id").alias("id"), (-F.col("row") if keep == "max" else F.col("row")).alias("r"))
    runs = digests.select("run", *DIGEST, rank.alias("best"), F.lit(1).cast("long").alias("n"))
    last = digests.agg(F.max("run")).first()[0] or 0
    level = 0
    while True:
        runs = runs.groupBy("run", *DIGEST).agg(best("best").alias("best"), F.sum("n").alias("n"))
        if last >> (FAN_IN_BITS * level) == 0:
            break
        level += 1
        runs = runs.withColumn("run", F.shiftright("run", FAN_IN_BITS))
    groups = runs.select(*DIGEST, F.col("best.id").alias("keep_id"), F.abs("best.r").alias("keep_row"), F.col("n").alias("group_size"))
    return digests.join(groups, DIGEST).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay. Rows repeated with one id and text shrink to one.

    Ids decide alone where all rows of an id go, so only ids move. Rows without an id, and rows of an id
    that has rows of both kinds, are told apart by their texts' digests; null texts count as empty.
    """
    groups = stored(exact_groups(docs, id_col, text_col, keep).select(F.col("doc_id").alias(id_col), "kept", "text_sha256"), "copies")
    by_id = groups.groupBy(id_col).agg(F.max("kept").alias("some"), F.min("kept").alias("all")).where("not all")
    by_id = stored(by_id, "copied-ids")
    left = by_ids(docs, by_id.where(F.col(id_col).isNotNull() & ~F.col("some")).select(id_col), "left_anti", id_col)
    mixed = by_id.where(F.col(id_col).isNull() | F.col("some")).select(id_col)
    if not mixed.take(1):
        return left
    key, sha = free_name(docs, "key"), free_name(docs, "sha")
    mixed = mixed.select(F.col(id_col).alias(key))
    doubtful = F.col(id_col).eqNullSafe(F.col(key))
    clear = left.join(mixed, doubtful, "left_anti")
    kept = groups.where("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha)).distinct()
    digest = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), 256)
    unclear = left.join(mixed, doubtful, "left_semi").join(kept, doubtful & (digest == F.col(sha)), "left_semi")
    # Only repeats of one (id, folded text) are left; for them any row serves.
    return clear.unionByName(unclear.withColumn(sha, digest).dropDuplicates([id_col, sha]).drop(sha))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
