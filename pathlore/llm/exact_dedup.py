"""Exact duplicates by progressive refinement: length, then a hash of the first bytes, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.llm._common import read, stored, text_or_empty

#: Characters whose hash is the second refinement.
PREFIX = 64
#: Key rows (two or three hashes each) that may be broadcast; larger key tables are joined by a shuffle.
BROADCAST_ROWS = 400_000


def normalised(text: str | Column) -> Column:
    """Text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def _small(keys: DataFrame) -> DataFrame:
    """keys, marked for broadcast when counted to be few; keys is a stored table."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, full_hash, and the carried columns.

    Texts are equal when identical after normalised(). The first scan counts rows by length and prefix hash; lengths
    and then prefixes that one row alone has drop out; the second scan hashes whole texts of the surviving groups only
    (full_hash is null for the others). Of equal texts the smallest id stays; null counts as larger than any id and
    rows that repeat the smallest id all stay, so an id is kept or dropped as a whole. Null texts are empty texts. An
    empty table gives no rows. carry: columns to compute of the input's columns in the second scan, where ``_text`` is
    the normalised text. Groups are counted before they are shuffled, so a large group is no large partition.
    """
    whole = docs.withColumn("_text", normalised(text))
    keys = [F.octet_length("_text").alias("_len"), F.xxhash64(F.substring("_text", 1, PREFIX)).alias("_prefix")]
    sketch = stored(whole.select(*keys).groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("n")), "dedup-sketch")
    lengths = sketch.groupBy("_len").agg(F.sum("n").alias("of_len")).where("of_len > 1").select("_len")
    prefixes = stored(sketch.where("n > 1").join(lengths, "_len", "left_semi").select("_len", "_prefix", F.lit(True).alias("_again")), "dedup-prefixes")

    carried = carry or {}
    rows = whole.select(F.col(id_col).alias("doc_id"), "_text", *keys, *[c.alias(n) for n, c in carried.items()])
    hashed = stored(
        rows.join(_small(prefixes), ["_len", "_prefix"], "left").select(
            "doc_id", "_len", "_prefix", F.when(F.col("_again"), F.sha2("_text", 256)).alias("full_hash"), *carried
        ),
        "dedup-hashed",
    )
    found = hashed.where("full_hash is not null").groupBy("full_hash", "_len", "_prefix").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = stored(found.where("n > 1"), "dedup-groups")
    joined = hashed.join(_small(groups), ["full_hash", "_len", "_prefix"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "full_hash", *carried,
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents, with every text's digest."""
    docs = read(spark, sf_dir, "documents")
    return exact_dedup(docs, carry={"text_sha256": F.sha2("_text", 256)}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
