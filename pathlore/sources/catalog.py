"""Listings to catalogs, and catalogs on disk."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pathlore.functions import text as tx

#: Directories that count as one thing: what lies inside isn't listed. A default of ours, to be set by the caller.
PACKAGES = ("app", "bundle", "framework", "plugin", "kext", "xcodeproj", "rtfd")
COLUMNS = [
    "id", "name", "normalized_name", "pinyin_name", "pinyin_compact", "pinyin_initials", "path", "normalized_path",
    "file_extension", "is_directory", "size", "created_at", "modified_at",
]
MANIFEST = "version int, root_path string, root_paths array<string>, item_count long, saved_at timestamp"


def scan(listing: DataFrame) -> DataFrame:
    """Entries that are no symlinks; null flags are false."""
    return listing.where(~F.coalesce("is_symlink", F.lit(False)))


#: Records of which a task makes postings or pairs, about; tasks for each core, from which on there are no more of them
#: before each has MOST_RECORDS.
TASK_RECORDS, TASKS_A_CORE, MOST_RECORDS = 20_000, 4, 500_000


def dealt(listing: DataFrame, by: str = "path") -> DataFrame:
    """The listing in even tasks. A file of one row group is one task, however many cores there are, and what is made of
    its records is a hundred times their size: then records are dealt by a column, else they stay where they are. Rows are
    counted where they are read, for a file by its footer."""
    spark = listing.sparkSession
    n, most = listing.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    tasks = min(-(-n // TASK_RECORDS), max(TASKS_A_CORE * cores, -(-n // MOST_RECORDS)))
    return listing.repartition(tasks, by) if most > TASK_RECORDS and most * cores > 2 * n else listing


def skip_packages(listing: DataFrame, packages: Sequence[str] = PACKAGES) -> DataFrame:
    """Without what lies inside a package; the package itself stays."""
    return listing.where(~F.col("path").rlike(r"\.(" + "|".join(packages) + ")/"))


def ancestors(path: Column) -> Column:
    """Every directory above a path, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 2, F.sequence(F.lit(2), F.size(parts) - 1)).otherwise(F.array()), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def directories(listing: DataFrame) -> DataFrame:
    """The directories that a listing of files implies."""
    return listing.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().select(
        "path", F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_directory"), F.lit(False).alias("is_symlink"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("modified_at"),
    )


def multi_root(roots: Sequence[DataFrame]) -> DataFrame:
    """All roots' entries, of equal paths that of the first root; root_ord tells the root. One root needs no shuffle."""
    tagged = [r.withColumn("root_ord", F.lit(i)) for i, r in enumerate(roots)]
    if len(tagged) == 1:
        return tagged[0]
    whole = tagged[0]
    for r in tagged[1:]:
        whole = whole.unionByName(r)
    first = Window.partitionBy("path").orderBy("root_ord", "size")
    return whole.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def limited(entries: DataFrame, n: int) -> DataFrame:
    """The first n entries over all roots in order, by path within a root."""
    return entries.orderBy("root_ord", "path").limit(n)


def records(listing: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The catalog of a listing: one projection, with Python for the ids and for names in other scripts alone. Columns
    of the listing in carry come after it."""
    base = listing.select(
        *carry, "path", tx.file_name(F.col("path")).alias("name"), F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("size"),
        F.coalesce("is_directory", F.lit(False)).alias("is_directory"), F.col("created_at").cast("timestamp"), F.col("modified_at").cast("timestamp"),
    ).withColumns({"normalized_name": tx.normalize(F.col("name")), "normalized_path": tx.normalize(F.col("path")), "file_extension": tx.extension(F.col("name"))})
    latin = tx.with_latin(base, "name", "pinyin_name")
    return latin.withColumns(
        {"pinyin_compact": tx.compact(F.col("pinyin_name")), "pinyin_initials": tx.initials(F.col("pinyin_name")), "id": tx.stable_id("normalized_path")}
    ).select(*COLUMNS, *carry)


def repeated(catalog: DataFrame) -> DataFrame:
    """Ids and paths that more than one record has."""
    by = lambda c: catalog.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("column", F.lit(c))
    return by("id").unionByName(by("path"))


def save(catalog: DataFrame, folder: str, roots: Sequence[str], saved_at: Column | None = None) -> None:
    """Records as Parquet, and a one-row manifest."""
    spark = catalog.sparkSession
    catalog.write.mode("overwrite").parquet(f"{folder}/records")
    n = spark.read.parquet(f"{folder}/records").count()
    row = spark.createDataFrame([(2, roots[0], list(roots), n)], "version int, root_path string, root_paths array<string>, item_count long")
    row.withColumn("saved_at", saved_at if saved_at is not None else F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The manifest's row; None when it is missing or can't be read."""
    try:
        row = spark.read.schema(MANIFEST).json(f"{folder}/manifest").where("item_count is not null")
        return row if row.take(1) else None
    except AnalysisException:
        return None


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The saved records; an older catalog of JSON rows is rewritten as Parquet once."""
    try:
        return spark.read.parquet(f"{folder}/records")
    except AnalysisException:
        kinds = {"id": "long", "is_directory": "boolean", "size": "long", "created_at": "timestamp", "modified_at": "timestamp"}
        old = spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in COLUMNS)).json(f"{folder}/records-json")
        old.write.parquet(f"{folder}/records")
        return spark.read.parquet(f"{folder}/records")


def save_bucketed(catalog: DataFrame, folder: str, buckets: int | None = None) -> DataFrame:
    """Records as a table dealt and sorted by id into as many files as buckets, by default as shuffles make partitions.
    Joins by id read it without an exchange: only what it is joined with is dealt."""
    spark = catalog.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"catalog_{uuid.uuid4().hex}"
    catalog.repartition(n, "id").write.bucketBy(n, "id").sortBy("id").option("path", folder).format("parquet").saveAsTable(name)
    return spark.table(name)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a saved catalog with all that lies beside it; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def storage_bytes(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
