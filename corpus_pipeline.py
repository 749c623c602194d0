"""The corpus pipeline: toxic rows out, repeated lines out, one of near duplicates, benchmark rows out, packed.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of ``documents``. Every stage works on all rows
of its predecessor: null and empty texts pass the first four, and are packed as an end token; an empty table goes
through as one; repeated rows are treated alike, and a column of an operator's name in the input is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from pathlore.llm._common import new_folder, packed, read


def _carried(docs: DataFrame) -> DataFrame:
    """The row as one struct, beside the two columns that operators look at: no name can clash."""
    return docs.select(packed(docs).alias("own"), "doc_id", "text")


def _columns(rows: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of docs again, with the text of that column."""
    new = {"text": F.col(text)} if text else {}
    return rows.select(*[new.get(c, F.col("own").getField(c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the severity model doesn't reject."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return _columns(toxicity.score(_carried(docs), model, columns=["own"]).where("NOT toxic"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the runs of lines that an earlier row or place has; n_chars is of the new text."""
    out = _columns(line_dedup.line_dedup(_carried(docs), long_lines=True), docs, "text")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id."""
    return _columns(near_dedup.near_dedup(_carried(docs)).where("kept"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    found = decontaminate.contained_items(_carried(docs), read(spark, sf_dir, "benchmark"), columns=["own"])
    return _columns(found.where(F.size("hits") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2048 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Hashes of vocabularies, sketches and fitted weights have no SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
